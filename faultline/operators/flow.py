"""Facts that flow along the edges of many graphs at once (may and must), as bits, by joins.

A fact of a procedure is a bit of a numbered word; a row holds 64 facts of a node. Each round sends only the bits that the last one
added along the edges of their nodes, so a round's work is the change, and a fixpoint ends it; loops, joins and early exits need
nothing special. A fact that must hold on every path is one whose absence cannot reach the node, so both questions are one loop.
Procedures of a bounded size go to tasks, where the same rounds run over the words of thousands of them as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import whole
from .fixpoint import _cut, _drop

#: The word of the bit that says that a node can be reached at all.
REACHED = -1


def _numbered(facts: DataFrame) -> DataFrame:
    """proc, fact, part, word, bit: neighbours in (proc, part) share words. A procedure of any size spreads over tasks."""
    dealt = facts.distinct().repartitionByRange("proc", "part", "fact").sortWithinPartitions("proc", "part", "fact")
    return _cut(dealt.withColumn("n", F.monotonically_increasing_id())).select("proc", "fact", "part", F.expr("shiftright(n, 6)").alias("word"), F.expr("shiftleft(1L, CAST(n & 63 AS INT))").alias("bit"))


def _minus(left: DataFrame, right: DataFrame | None, key: list[str]) -> DataFrame:
    """left's bits without those of right's rows of the same key."""
    if right is None:
        return left
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("off", F.lit(0).cast("long"))))
    return left.join(right.withColumnRenamed("bits", "off"), key, "left").withColumn("bits", rest).drop("off").filter("bits <> 0")


def _union(*rows: DataFrame | None) -> DataFrame:
    given = [r for r in rows if r is not None]
    out = given[0]
    for r in given[1:]:
        out = out.unionByName(r)
    return out


def _bits(rows: DataFrame | None, at: list[str], known: DataFrame) -> DataFrame | None:
    """Rows by fact (or, without one, by part) as words of bits."""
    if rows is None:
        return None
    key = ["proc", "fact", "part"] if "fact" in rows.columns else ["proc", "part"]
    return rows.select(*at, *key[1:]).join(known, key).groupBy(*at, "word").agg(F.bit_or("bit").alias("bits"))


def _either(left: DataFrame | None, right: DataFrame | None, key: list[str]) -> DataFrame | None:
    given = [x for x in (left, right) if x is not None]
    return _union(*given).groupBy(*key).agg(F.bit_or("bits").alias("bits")) if given else None


def flow_facts(edges: DataFrame, starts: DataFrame, gen: DataFrame | None = None, kill: DataFrame | None = None, at_start: DataFrame | None = None, edge_gen: DataFrame | None = None, edge_kill: DataFrame | None = None, ask: str = "both", tell: DataFrame | None = None) -> DataFrame:
    """(proc, node, fact, part, must): the facts that may hold where a node begins, for the nodes that can be reached, and whether
    they hold on every way there. ask: "may" or "must" alone save the work of the other.

    edges: (proc, src, dst) and, where two edges join the same nodes, a label. starts: (proc, node). gen: (proc, node, fact, part)
    that hold after a node; kill: (proc, node, part), which ends all facts of that part in its procedure; a node kills first, then
    generates. at_start: (proc, node, fact, part) that hold at starts. edge_gen and edge_kill are the same with (src, dst, label)
    in place of the node: what is learnt on a branch, after the node. Facts that are only killed are none. tell: (proc, node), the
    nodes to tell of; all if none are given."""
    edges = edges if "label" in edges.columns else edges.withColumn("label", F.lit(""))
    tables = [edges, starts, gen, kill, at_start, edge_gen, edge_kill]
    if not whole.are_numbers(tables, ("node", "src", "dst", "fact", "part")):
        return _in_rounds(*tables, ask, tell)
    tables.append(tell)
    source = [t if t is None or "node" in t.columns else t.withColumnRenamed("src", "node") for t in tables]
    small, large = whole.dealt(whole.one_table(source, COLUMNS))
    kinds = lambda *names: whole.widest(*[k for t in tables if t is not None for c, k in t.dtypes if c in names])
    proc = edges.schema["proc"].dataType.simpleString()
    found = small.mapInArrow(whole.by_procedures(_solver(ask, tell is not None)), f"proc {proc}, node bigint, fact bigint, part bigint, must boolean")
    found = found.select("proc", *[F.col(c).cast(kinds(*of)).alias(c) for c, of in (("node", ("node", "dst")), ("fact", ("fact",)), ("part", ("part",)))], "must")
    if large is None:
        return found
    *rest, told = [None if t is None else t.join(large, "proc", "left_semi") for t in tables]
    return found.unionByName(_in_rounds(*rest, ask, told))


#: What the rows of edges, starts, gen, kill, at_start, edge_gen, edge_kill and tell hold as one table.
COLUMNS = {"node": "bigint", "dst": "bigint", "label": "string", "fact": "bigint", "part": "bigint"}
EDGE, START, GEN, KILL, AT_START, EDGE_GEN, EDGE_KILL, TELL = range(8)
#: Pairs of a node and a fact that are told at once.
TOLD = 1_000_000


def _solver(ask: str, some_only: bool):
    """The rounds of some whole procedures: a cell is a node's word of 64 facts, a link a word of an edge; both are arrays."""

    def solve(table: pa.Table, proc: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind, label = table.column("kind").to_numpy(), whole.texts(table.column("label"))[0]
        (node, no_node), (dst, no_dst), (fact, no_fact), (part, no_part) = (whole.numbers(table.column(c)) for c in ("node", "dst", "fact", "part"))
        on_edge, of_fact, of_part = np.isin(kind, (EDGE, EDGE_GEN, EDGE_KILL)), np.isin(kind, (GEN, AT_START, EDGE_GEN)), np.isin(kind, (KILL, EDGE_KILL))
        use = ~(no_node | (on_edge & no_dst) | (of_fact & (no_fact | no_part)) | (of_part & no_part))
        names, procs = table.column("proc").take(pa.array(whole.runs(proc))), int(proc[-1]) + 1
        kind, proc, node, dst, label, fact, part = (x[use] for x in (kind, proc, node, dst, label, fact, part))
        rows = lambda k: np.flatnonzero(kind == k)
        # nodes and edges, numbered
        e = rows(EDGE)
        at, number = whole.coded(np.concatenate([proc, proc[e]]), np.concatenate([node, dst[e]]))
        of_node, id_node = np.concatenate([proc, proc[e]])[at], np.concatenate([node, dst[e]])[at]
        here = number[: len(proc)]
        linked = np.concatenate([e, rows(EDGE_GEN), rows(EDGE_KILL)])
        at, edge = whole.coded(proc[linked], node[linked], dst[linked], label[linked])
        edge_of = np.full(len(proc), -1)
        edge_of[linked] = edge
        e_src, e_dst = np.full(len(at), -1), np.full(len(at), -1)
        e_src[edge_of[e]], e_dst[edge_of[e]] = here[e], number[len(proc) :]
        # facts of a procedure, those of a part together, 64 a word
        named = np.concatenate([rows(GEN), rows(AT_START), rows(EDGE_GEN)])
        at, of = whole.coded(proc[named], part[named], fact[named])
        fact_of = np.full(len(proc), -1)
        fact_of[named] = of
        f_proc, f_part, f_fact = proc[named][at], part[named][at], fact[named][at]
        f_size = np.bincount(f_proc, minlength=procs)
        f_first = np.cumsum(f_size) - f_size
        place = np.arange(len(f_proc)) - f_first[f_proc]
        word, bit = place >> 6, np.uint64(1) << (place & 63).astype(np.uint64)
        words = (f_size + 63) >> 6
        p_begin = whole.runs(whole.coded(f_proc, f_part)[1])
        p_size = np.diff(np.concatenate([p_begin, [len(f_proc)]]))

        def bits(base: np.ndarray, at: np.ndarray, facts: np.ndarray, cells: int) -> np.ndarray:
            out = np.zeros(cells, np.uint64)
            np.bitwise_or.at(out, base[at] + word[facts], bit[facts])
            return out

        def ended(k: int) -> tuple[np.ndarray, np.ndarray]:
            """Rows of kind k and all facts of their part."""
            r = rows(k)
            if not len(r) or not len(p_begin):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            both, code = whole.coded(np.concatenate([f_proc[p_begin], proc[r]]), np.concatenate([f_part[p_begin], part[r]]))
            of_code = np.full(len(both), -1)
            of_code[code[: len(p_begin)]] = np.arange(len(p_begin))
            run = of_code[code[len(p_begin) :]]
            r, run = r[run >= 0], run[run >= 0]
            facts, of = whole.spread(p_begin[run], p_size[run])
            return r[of], facts

        n_words, l_words = words[of_node], np.where(e_src >= 0, words[of_node[e_src]], 0) if len(e_src) else np.zeros(0, np.int64)
        base, l_base = np.cumsum(n_words) - n_words, np.cumsum(l_words) - l_words
        cells, links = int(n_words.sum()), int(l_words.sum())
        on_link = lambda r, facts: bits(l_base, edge_of[r][e_src[edge_of[r]] >= 0], facts[e_src[edge_of[r]] >= 0], links)
        w, l_edge = whole.spread(np.zeros(len(l_words), np.int64), l_words)
        l_src, l_dst = base[e_src[l_edge]] + w, base[e_dst[l_edge]] + w
        g, begin = bits(base, here[rows(GEN)], fact_of[rows(GEN)], cells), bits(base, here[rows(AT_START)], fact_of[rows(AT_START)], cells)
        r, facts = ended(KILL)
        g, k = g[l_src], bits(base, here[r], facts, cells)[l_src]
        eg, ek = on_link(rows(EDGE_GEN), fact_of[rows(EDGE_GEN)]), on_link(*ended(EDGE_KILL))
        # which nodes can be reached
        reached = np.zeros(len(of_node), bool)
        reached[here[rows(START)]] = True
        real = e_src >= 0
        a, b = e_src[real], e_dst[real]
        new = reached.copy()
        while new.any():
            to = b[new[a]]
            new = np.zeros(len(of_node), bool)
            new[to] = ~reached[to]
            reached |= new
        keep = np.flatnonzero(reached[e_src[l_edge]])
        keep = keep[np.argsort(l_dst[keep], kind="stable")]
        l_src, l_dst = l_src[keep], l_dst[keep]

        def settled(state: np.ndarray, ends: np.ndarray, brings: np.ndarray) -> np.ndarray:
            ends, brings = ~ends[keep], brings[keep]
            active = None
            while True:
                go = np.arange(len(l_src)) if active is None else np.flatnonzero(active[l_src])
                if not len(go):
                    return state
                to = l_dst[go]
                first = whole.runs(to)
                to = to[first]
                came = np.bitwise_or.reduceat((state[l_src[go]] & ends[go]) | brings[go], first) & ~state[to]
                state[to] |= came
                active = np.zeros(len(state), bool)
                active[to[came != 0]] = True

        w_node, n_of = whole.spread(np.zeros(len(n_words), np.int64), n_words)
        left = np.minimum(f_size[of_node[n_of]] - 64 * w_node, 64)
        every = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & 63).astype(np.uint64)) - np.uint64(1))
        may, absent = None, None
        if ask != "must":
            may = settled(begin.copy(), k | ek, (g & ~ek) | eg)
        if ask != "may":
            state = np.zeros(cells, np.uint64)
            first = np.zeros(len(of_node), bool)
            first[here[rows(START)]] = True
            state[first[n_of]] = every[first[n_of]] & ~begin[first[n_of]]
            absent = settled(state, g | eg, (k & ~g & ~eg) | (ek & ~eg))
        held = every & ~absent if ask == "must" else may
        # told by node and fact, some nodes at once
        asked = np.full(len(of_node), not some_only)
        asked[here[rows(TELL)]] = True
        told = np.flatnonzero(reached & asked & (f_size[of_node] > 0))
        upto = np.cumsum(f_size[of_node[told]])
        cut = 0
        while cut < len(told):
            stop = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + TOLD, "right")))
            some = told[cut:stop]
            cut = stop
            facts, of = whole.spread(f_first[of_node[some]], f_size[of_node[some]])
            cell = base[some[of]] + word[facts]
            yes = np.flatnonzero(held[cell] & bit[facts])
            facts, of, cell = facts[yes], some[of[yes]], cell[yes]
            must = pa.nulls(len(yes), pa.bool_()) if ask == "may" else pa.array((absent[cell] & bit[facts]) == 0)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of_node[of])).combine_chunks(), pa.array(id_node[of]), pa.array(f_fact[facts]), pa.array(f_part[facts]), must], ["proc", "node", "fact", "part", "must"])

    return solve


def _in_rounds(edges: DataFrame, starts: DataFrame, gen: DataFrame | None, kill: DataFrame | None, at_start: DataFrame | None, edge_gen: DataFrame | None, edge_kill: DataFrame | None, ask: str, tell: DataFrame | None = None) -> DataFrame:
    """The same by joins, a round at a time, for procedures of any size."""
    link, node = ["proc", "src", "dst", "label"], ["proc", "node"]
    edges = _cut(edges.select(*link).distinct())
    known = _numbered(_union(*[x.select("proc", "fact", "part") for x in (gen, at_start, edge_gen) if x is not None]))
    g, k, eg, ek = _bits(gen, node, known), _bits(kill, node, known), _bits(edge_gen, link, known), _bits(edge_kill, link, known)
    by_edge = lambda x: None if x is None else x.withColumnRenamed("node", "src").join(edges, ["proc", "src"])
    on_link = [*link, "word"]
    begin, first = _bits(at_start, node, known), starts.select(*node).distinct()
    every = known.groupBy("proc", "word").agg(F.bit_or("bit").alias("bits"))
    ways = []  # what an edge ends and what it brings, for each question
    if ask != "must":
        brings = _either(None if g is None else _minus(by_edge(g), ek, on_link), eg, on_link)
        ways.append(("may", begin, _either(by_edge(k), ek, on_link), brings))
    if ask != "may":  # of absence: what generates ends it, what kills brings it
        gone = None if k is None else _minus(by_edge(k), None if g is None else by_edge(g), on_link)
        gone = None if gone is None else _minus(gone, eg, on_link)
        lost = None if ek is None else _minus(ek, eg, on_link)
        ways.append(("must", _minus(first.join(every, "proc"), begin, [*node, "word"]), _either(by_edge(g), eg, on_link), _either(gone, lost, on_link)))
    tagged = lambda rows, way, key: None if rows is None else rows.select(*key, F.lit(way).alias("way"), "word", "bits")
    all_of = lambda i, key: None if all(w[i] is None for w in ways) else _cut(_union(*[tagged(w[i], w[0], key) for w in ways]))
    begin, ends, brings = all_of(1, node), all_of(2, link), all_of(3, link)
    here = first.select(*node, F.lit("").alias("way"), F.lit(REACHED).cast("long").alias("word"), F.lit(1).cast("long").alias("bits"))
    state = [*node, "way", "word"]
    new = _cut(_union(here, begin))
    parts = [new]
    while not new.isEmpty():
        sent = _minus(new.withColumnRenamed("node", "src").join(edges, ["proc", "src"]), ends, [*link, "way", "word"])
        reached = new.filter(F.col("word") == REACHED).select("proc", F.col("node").alias("src"))
        brought = None if brings is None else reached.join(brings, ["proc", "src"]).select(*sent.columns)
        came = _union(sent, brought).groupBy("proc", F.col("dst").alias("node"), "way", "word").agg(F.bit_or("bits").alias("bits"))
        new = _cut(_minus(came, _union(*parts).groupBy(*state).agg(F.bit_or("bits").alias("bits")), state))
        parts.append(new)
        if len(parts) == 8:
            whole = _cut(_union(*parts).groupBy(*state).agg(F.bit_or("bits").alias("bits")))
            for p in parts[:-1]:
                _drop(p)
            parts = [whole]
    for x in (edges, ends, brings):
        if x is not None:
            _drop(x)
    found = _union(*parts)
    of = lambda way: found.filter(F.col("way") == way).groupBy(*node, "word").agg(F.bit_or("bits").alias(way))
    if ask == "must":
        held = found.filter(F.col("word") == REACHED).select(*node).join(every, "proc")
    else:
        held = of("may").withColumnRenamed("may", "bits")
    absent = F.lit(0).cast("long")
    if ask != "may":
        held = held.join(of("must"), [*node, "word"], "left")
        absent = F.coalesce("must", absent)
    held = held if tell is None else held.join(tell.select(*node).distinct(), node, "left_semi")
    told = held.join(known, ["proc", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    must = (absent.bitwiseAND(F.col("bit")) == 0) if ask != "may" else F.lit(None).cast("boolean")
    told = told.select(*node, "fact", "part", must.alias("must"))
    return told.filter("must") if ask == "must" else told


def dominators(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(proc, node, by): the nodes that every way from a start to node passes, node itself too."""
    nodes = edges.select("proc", F.col("src").alias("node")).unionByName(edges.select("proc", F.col("dst").alias("node"))).unionByName(starts.select("proc", "node"))
    own = nodes.select("proc", "node", F.col("node").alias("fact"), F.lit(0).alias("part"))
    # a fact of another part, which all starts have, holds wherever a node is reached
    begun = starts.select("proc", "node", F.lit("0").cast(dict(starts.dtypes)["node"]).alias("fact"), F.lit(1).alias("part"))
    above = flow_facts(edges, starts, gen=own, at_start=begun, ask="must")
    return above.filter("part = 1 OR node <> fact").select("proc", "node", F.when(F.col("part") == 1, F.col("node")).otherwise(F.col("fact")).alias("by"))
