"""Programs to findings: front ends, flow graphs, taint and structural detectors, all per file."""
