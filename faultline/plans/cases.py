"""Labelled programs in five languages: each weakness beside a near-identical safe twin.

A line that is a finding ends in a mark, `//! type` or `#! type`, with `@n` after the type for the line that its data comes from.
The mark is the label: it is cut off before a program is scanned. Each part becomes one of them, under its own variable names
(QQ is its key) and behind some lines of comment, so the number of programs grows with the table.
"""

from __future__ import annotations

import re

PYTHON = '''
import os
from flask import request
def runQQ():
    aQQ = request.args.get("q")
    os.system("ls " + aQQ)  #! command_injection@5
---
import os, shlex
from flask import request
def runQQ():
    aQQ = shlex.quote(request.args.get("q"))
    os.system("ls " + aQQ)
---
import sqlite3
def findQQ(db):
    name = input()
    q = f"SELECT * FROM t WHERE n = '{name}'"
    db.execute(q)  #! sql_injection@4
---
import sqlite3
def findQQ(db):
    name = input()
    db.execute("SELECT * FROM t WHERE n = ?", (name,))
---
def viewQQ(request):
    n = int(request.GET["n"])
    open("/srv/" + str(n))
---
def viewQQ(request):
    n = request.GET["n"]
    open("/srv/" + n)  #! path_traversal@3
---
def viewQQ(request):
    n = request.GET["n"]
    if ".." in n:
        return None
    return open("/srv/" + n)
---
from flask import request
def pickQQ():
    x = request.form["x"]
    if x.isdigit():
        eval(x)
    else:
        eval(x)  #! code_injection@4
---
from flask import request
def wrapQQ(a, b):
    os.system(b)  #! command_injection@6
def outerQQ():
    v = request.args["v"]
    wrapQQ("x", v)
    wrapQQ(v, "x")
---
from flask import request
def cleanQQ(x):
    return shlex.quote(x)
def outerQQ():
    v = cleanQQ(request.args["v"])
    os.system(v)
---
from flask import request
class BoxQQ:
    def __init__(self):
        self.q = request.args.get("q")
        self.k = "fixed"
    def go(self):
        eval(self.q)  #! code_injection@5
        eval(self.k)
---
from flask import request
def dictQQ():
    d = {}
    d["a"] = request.args.get("a")
    d["b"] = "b"
    os.system(d["b"])
    os.system(d["a"])  #! command_injection@5
---
from flask import request
def dictQQ():
    d = {}
    d["a"] = request.args.get("a")
    d["a"] = "b"
    os.system(d["a"])
---
from flask import request
def loopQQ():
    out = ""
    for part in request.args.getlist("p"):
        out += part
    subprocess.call(out, shell=True)  #! command_injection@5
---
import subprocess
from flask import request
def listQQ():
    p = request.args.get("p")
    subprocess.run(["ls", p])
---
from flask import request
def branchQQ(flag):
    v = "safe"
    if flag:
        v = request.args.get("v")
    os.system(v)  #! command_injection@6
---
from flask import request
def deadQQ():
    v = request.args.get("v")
    if 1 > 2:
        os.system(v)
    return "x"
---
import pickle
def loadQQ(request):
    raw = request.COOKIES.get("s")
    return pickle.loads(raw)  #! deserialization@4
---
import yaml
def loadQQ(request):
    a = yaml.load(request.body)  #! deserialization@4
    b = yaml.load(request.body, Loader=yaml.SafeLoader)
---
from flask import redirect, request
def goQQ():
    return redirect(request.args.get("next"))  #! open_redirect@4
---
from flask import redirect, request
def goQQ():
    to = request.args.get("next")
    if to.startswith("/"):
        return redirect(to)
    return redirect("/")
---
import requests
from flask import request
def fetchQQ():
    u = request.args.get("u")
    if u in ("http://a", "http://b"):
        return requests.get(u)
    return requests.get(u)  #! ssrf@5
---
import hashlib
def sumQQ(b):
    x = hashlib.md5(b)  #! weak_hash
    y = hashlib.md5(b, usedforsecurity=False)
    z = hashlib.sha256(b)
---
import random, secrets
def tokenQQ():
    a = random.randint(0, 9)  #! insecure_random
    b = secrets.token_hex()
---
import os
def modesQQ():
    os.chmod("f", 0o644)
    os.chmod("g", 0o666)  #! incorrect_permissions
---
api_key = "k9f8s7d6QQ"  #! hardcoded_secret
password = "changeme"
host = "k9f8s7d6QQ"
---
DB = "postgres://app:hunterQQ@db/x"  #! hardcoded_secret
DB2 = "postgres://app:{password}@db/x"
---
def downQQ(n):
    return downQQ(n - 1)  #! uncontrolled_recursion
---
def downQQ(n):
    if n == 0:
        return 0
    return downQQ(n - 1)
---
def downQQ(n):
    return n and downQQ(n - 1)
---
def spinQQ(q):
    while True:  #! infinite_loop
        q.work()
---
def spinQQ(q):
    while True:
        if q.done():
            break
---
import re
from flask import request
def matchQQ(s):
    a = re.compile("^(a+)+$")  #! regex_dos
    b = re.compile("^(ab)+$")
    c = re.compile(request.args["r"])  #! regex_dos@7
---
from flask import Response, request
@app.route("/h/<name>")
def helloQQ(name):
    return "<b>" + name + "</b>"  #! xss@4
---
from flask import request
from markupsafe import escape
@app.route("/h/<name>")
def helloQQ(name):
    name = escape(name)
    return "<b>" + name + "</b>"
---
from flask import render_template_string, request
def pageQQ():
    t = request.args.get("t")
    return render_template_string("<p>" + t)  #! template_injection@4
---
from lxml import etree
def xmlQQ(request):
    etree.fromstring(request.body)  #! xxe@4
---
def orderQQ(request):
    o = Order.objects.get(id=request.GET["id"])  #! idor@3
    return o
---
def orderQQ(request):
    o = Order.objects.get(id=request.GET["id"], owner=request.user)
    return o
---
def orderQQ(request):
    i = request.GET["id"]
    o = Order.objects.get(id=i)
    if o.owner != request.user:
        raise PermissionError
    return o
---
def cookieQQ(resp):
    resp.set_cookie("s", "v", secure=True)  #! insecure_cookie_httponly
    resp.set_cookie("s", "v", secure=True, httponly=True)
'''

JAVASCRIPT = '''
const { exec } = require("child_process");
app.get("/x", (req, res) => {
  const qQQ = req.query.q;
  exec("ls " + qQQ); //! command_injection@4
});
---
const { execFile } = require("child_process");
app.get("/x", (req, res) => {
  const qQQ = req.query.q;
  const m = /a(b)/.exec(qQQ);
});
---
app.post("/y", function (r, res) {
  const n = r.body.name;
  res.send("<p>" + n + "</p>"); //! xss@3
});
---
app.post("/y", function (r, res) {
  const n = escapeHtml(r.body.name);
  res.send("<p>" + n + "</p>");
});
---
function showQQ() {
  document.getElementById("o").innerHTML = location.hash; //! xss@3
}
---
function showQQ() {
  document.getElementById("o").textContent = location.hash;
}
---
function mergeQQ(t, s) {
  for (const k in s) {
    if (typeof s[k] === "object") { mergeQQ(t[k], s[k]); }
    else { t[k] = s[k]; } //! prototype_pollution
  }
}
---
function mergeQQ(t, s) {
  for (const k in s) {
    if (k === "__proto__") continue;
    if (typeof s[k] === "object") { mergeQQ(t[k], s[k]); }
    else { t[k] = s[k]; }
  }
}
---
function putQQ(o, a, b, v) {
  o[a][b] = v; //! prototype_pollution
}
---
const badQQ = /^(\\w+\\s?)*$/; //! regex_dos
const alsoQQ = /(x|xy)+z/; //! regex_dos
const goodQQ = /^[a-z]+(?:-[a-z]+)?$/;
---
function pageQQ(props) {
  const h = location.search;
  return <div dangerouslySetInnerHTML={{ __html: h }} />; //! xss@3
}
---
function pageQQ(props) {
  const h = location.search;
  return <div title={h}>{h}</div>;
}
---
app.get("/f", (req, res) => {
  fs.readFile("/srv/" + req.params.f, cb); //! path_traversal@3
  fs.readFile("/srv/" + path.basename(req.params.f), cb);
});
---
app.get("/s", async (req, res) => {
  const { id } = req.body;
  const rows = await db.query("SELECT * FROM t WHERE id = " + id); //! sql_injection@3
  const more = await db.query("SELECT * FROM t WHERE id = ?", [id]);
});
---
app.get("/s", (req, res) => {
  const idQQ = parseInt(req.query.id);
  db.query(`SELECT * FROM t WHERE id = ${idQQ}`);
});
---
app.get("/s", (req, res) => {
  const idQQ = req.query.id;
  db.query(`SELECT * FROM t WHERE id = ${idQQ}`); //! sql_injection@3
});
---
class RunnerQQ {
  constructor() { this.cmd = process.argv[2]; }
  go() { require("child_process").execSync(this.cmd); } //! command_injection@3
}
---
const hQQ = crypto.createHash("md5"); //! weak_hash
const iQQ = crypto.createHash("sha256");
const tQQ = Math.random(); //! insecure_random
---
const passwordQQ = 5;
const password = "hunter2QQ"; //! hardcoded_secret
---
function spinQQ() {
  for (;;) { work(); } //! infinite_loop
}
---
function deepQQ(n) {
  return deepQQ(n + 1); //! uncontrolled_recursion
}
---
app.get("/r", (req, res) => {
  const to = req.query.to;
  if (ALLOWED.includes(to)) { res.redirect(to); }
  else { res.redirect(to); } //! open_redirect@3
});
---
function evQQ(list) {
  const x = document.cookie;
  list.map((y) => eval(x)); //! code_injection@3
}
---
function helperQQ(a) { return "x" + a; }
app.get("/h", (req, res) => {
  eval(helperQQ(req.query.e)); //! code_injection@4
});
'''

JAVA = '''
public class AQQ extends HttpServlet {
  public void doGet(HttpServletRequest request, HttpServletResponse response) {
    String p = request.getParameter("id");
    Statement st = conn.createStatement();
    st.executeQuery("SELECT * FROM t WHERE id='" + p + "'"); //! sql_injection@4
  }
}
---
public class AQQ extends HttpServlet {
  public void doGet(HttpServletRequest request, HttpServletResponse response) {
    String p = request.getParameter("id");
    PreparedStatement st = conn.prepareStatement("SELECT * FROM t WHERE id=?");
    st.setString(1, p);
    st.executeQuery();
  }
}
---
public class BQQ {
  void go(HttpServletRequest request) {
    String param = request.getHeader("h");
    String bar;
    int num = 106;
    bar = (7 * 18) + num > 200 ? "always" : param;
    new File(bar);
  }
}
---
public class BQQ {
  void go(HttpServletRequest request) {
    String param = request.getHeader("h");
    String bar;
    int num = 86;
    if ((7 * 42) - num > 200) bar = "no";
    else bar = param;
    new File(param); //! path_traversal@4
    new File(bar);
  }
}
---
public class CQQ {
  void go(HttpServletRequest request) {
    String param = request.getParameter("h");
    List<String> v = new ArrayList<String>();
    v.add("safe"); v.add(param); v.add("more");
    v.remove(0);
    String one = v.get(0);
    String two = v.get(1);
    Runtime.getRuntime().exec(one); //! command_injection@4
    Runtime.getRuntime().exec(two);
  }
}
---
public class CQQ {
  void go(HttpServletRequest request) {
    String param = request.getParameter("h");
    Map<String, Object> m = new HashMap<String, Object>();
    m.put("a", "safe");
    m.put("b", param);
    response.getWriter().println(m.get("a"));
    response.getWriter().println(m.get("b")); //! xss@4
  }
}
---
public class DQQ {
  void go(HttpServletRequest request) {
    String p = request.getParameter("h");
    response.getWriter().println(ESAPI.encoder().encodeForHTML(p));
  }
}
---
public class DQQ {
  private String name;
  void take(HttpServletRequest request) { name = request.getParameter("n"); }
  void use() { new FileInputStream(name); } //! path_traversal@4
}
---
public class EQQ {
  void go() {
    Cipher a = Cipher.getInstance("DES/CBC/PKCS5Padding"); //! weak_crypto
    Cipher b = Cipher.getInstance("AES/GCM/NoPadding");
    Cipher c = Cipher.getInstance("AES/ECB/PKCS5Padding"); //! weak_crypto
    MessageDigest d = MessageDigest.getInstance("MD5"); //! weak_hash
    MessageDigest e = MessageDigest.getInstance("SHA-512");
  }
}
---
public class FQQ {
  void go(HttpServletResponse response) {
    Cookie c = new Cookie("a", "b");
    c.setHttpOnly(true);
    response.addCookie(c); //! insecure_cookie
  }
}
---
public class FQQ {
  void go(HttpServletResponse response) {
    Cookie c = new Cookie("a", "b");
    c.setHttpOnly(true);
    c.setSecure(true);
    response.addCookie(c);
  }
}
---
public class GQQ {
  Object go(InputStream in) {
    ObjectInputStream o = new ObjectInputStream(in);
    return o.readObject(); //! deserialization
  }
}
---
public class HQQ {
  public String page(@RequestParam String q, int n) {
    jdbcTemplate.queryForList("SELECT " + q); //! sql_injection@3
    jdbcTemplate.queryForList("SELECT " + n);
    return "x";
  }
}
---
public class IQQ {
  void configure(HttpSecurity http) {
    http.csrf().disable(); //! csrf
  }
}
---
public class JQQ {
  void go(HttpServletRequest request) {
    String p = request.getParameter("k");
    switch (p) {
      case "a": p = "x"; break;
      default: p = "y";
    }
    request.getSession().setAttribute("k", p);
  }
}
---
public class JQQ {
  void go(HttpServletRequest request) {
    StringBuilder b = new StringBuilder();
    b.append("SELECT ").append(request.getParameter("k"));
    statement.executeUpdate(b.toString()); //! sql_injection@5
  }
}
---
public class KQQ {
  int spin(int n) {
    while (true) { n++; } //! infinite_loop
  }
  int down(int n) { return n <= 0 ? 0 : down(n - 1); }
  int fall(int n) { return fall(n - 1); } //! uncontrolled_recursion
}
---
public class LQQ {
  void go(HttpServletRequest request) {
    try {
      String p = request.getParameter("x");
      int n = Integer.parseInt(p);
      st.execute("SELECT " + n);
    } catch (Exception e) {
      response.sendRedirect(request.getParameter("to")); //! open_redirect@9
    }
  }
}
'''

CSHARP = '''
public class HomeController : Controller {
  [HttpGet]
  public IActionResult Get(string idQQ, int n) {
    var a = new SqlCommand("SELECT * FROM t WHERE id=" + idQQ, c); //! sql_injection@4
    var b = new SqlCommand("SELECT * FROM t WHERE id=@id", c);
    return View();
  }
}
---
public class RunQQ {
  void Go() {
    var x = Request.QueryString["a"];
    Process.Start("cmd.exe", "/c " + x); //! command_injection@4
  }
}
---
public class RunQQ {
  void Go() {
    var x = Request.QueryString["a"];
    int n = int.Parse(x);
    Process.Start("cmd.exe", "/c " + n);
  }
}
---
public class OutQQ {
  void Go() {
    string x = Request.Form["a"];
    Response.Write(HttpUtility.HtmlEncode(x));
    Response.Write($"<b>{x}</b>"); //! xss@4
  }
}
---
public class FileQQ {
  string Load() {
    string f = Request.Query["f"];
    using (var r = new StreamReader("/srv/" + Path.GetFileName(f))) { r.Read(); }
    return System.IO.File.ReadAllText("/srv/" + f); //! path_traversal@4
  }
}
---
public class CmdQQ {
  void Go(SqlCommand cmd) {
    string x = Console.ReadLine();
    cmd.CommandText = "DELETE FROM t WHERE n='" + x + "'"; //! sql_injection@4
  }
}
---
public class HashQQ {
  void Go() {
    var a = MD5.Create(); //! weak_hash
    var b = SHA256.Create();
    var d = DES.Create(); //! weak_crypto
  }
}
---
public class GoQQ {
  ActionResult Go() {
    string u = Request.QueryString["u"];
    if (Url.IsLocalUrl(u)) { return Redirect("/ok"); }
    return Redirect(u); //! open_redirect@4
  }
}
---
public class PropQQ {
  private string name;
  public PropQQ() { name = Request.Form["n"]; }
  void Use() { File.Delete(name); } //! path_traversal@4
}
---
public class LoopQQ {
  void Go() {
    string all = "";
    foreach (var k in Request.Form["ks"]) { all += k; }
    doc.LoadXml(all); //! xxe@5
  }
}
---
public class KeepQQ {
  string password = "hunter2QQ"; //! hardcoded_secret
  string user = "hunter2QQ";
}
'''

C = '''
#include <stdlib.h>
void fQQ(void) {
  char *p = malloc(10);
  if (p == NULL) return;
  free(p);
  p[1] = 2; //! use_after_free@6
}
---
void fQQ(void) {
  char *p = malloc(10);
  if (p == NULL) return;
  p[1] = 2;
  free(p);
}
---
void fQQ(int n) {
  char *p = malloc(10);
  if (n) free(p);
  free(p); //! double_free@4
}
---
void fQQ(int n) {
  char *p = malloc(10);
  if (n) { free(p); return; }
  free(p);
}
---
void fQQ(void) {
  int *p = malloc(4);
  *p = 1; //! null_dereference@3
  free(p);
}
---
void fQQ(void) {
  int *p = malloc(4);
  if (!p) exit(1);
  *p = 1;
  free(p);
}
---
void fQQ(int c) {
  char *q = malloc(3); //! memory_leak@3
  if (q == NULL) return;
  if (c) return;
  free(q);
}
---
char *fQQ(int c) {
  char *q = malloc(3);
  if (q == NULL) return NULL;
  return q;
}
---
char *fQQ(void) {
  char b[10];
  return b; //! return_stack_address
}
---
char *fQQ(void) {
  static char b[10];
  return b;
}
---
int fQQ(int c) {
  int x;
  if (c) x = 1;
  return x; //! uninitialized_var
}
---
int fQQ(int c) {
  int x;
  if (c) x = 1; else x = 2;
  return x;
}
---
int fQQ(int a) {
  int z = 0;
  return a / z; //! divide_by_zero
}
---
int fQQ(int a) {
  int z = 0;
  if (a) z = a;
  if (z == 0) return 0;
  return a / z;
}
---
void fQQ(void) {
  int a[5];
  a[5] = 1; //! oob_write
  a[4] = 1;
  a[-1] = 2; //! oob_underwrite
}
---
int fQQ(void) {
  int a[8] = {0};
  int s = a[8]; //! oob_read
  return s + a[-2]; //! oob_underread
}
---
void fQQ(void) {
  int a[10]; int i;
  for (i = 0; i <= 10; i++) {
    a[i] = i; //! oob_write
  }
}
---
void fQQ(void) {
  int a[10]; int i;
  for (i = 0; i < 10; i++) {
    a[i] = i;
  }
}
---
int main(int argc, char **argv) {
  char cmdQQ[100];
  snprintf(cmdQQ, 100, "ls %s", argv[1]);
  system(cmdQQ); //! command_injection@2
  return 0;
}
---
int main(int argc, char **argv) {
  int n = atoi(argv[1]);
  char cmdQQ[100];
  snprintf(cmdQQ, 100, "ls %d", n);
  system(cmdQQ);
  return 0;
}
---
void fQQ(void) {
  char *e = getenv("HOME");
  printf(e); //! format_string@3
  printf("%s", e);
}
---
void fQQ(void) {
  char b[4];
  strcpy(b, "hello"); //! buffer_overflow
  strcpy(b, "hey");
  memcpy(b, "abcdefgh", 8); //! buffer_overflow
}
---
void fQQ(void) {
  char b[16];
  scanf("%s", b); //! buffer_overflow
  scanf("%15s", b);
}
---
void fQQ(void) {
  int k;
  scanf("%d", &k);
  char *p = malloc(k); //! unbounded_allocation@4
  free(p);
}
---
void fQQ(void) {
  int k;
  scanf("%d", &k);
  if (k < 0 || k > 100) return;
  char *p = malloc(k);
  free(p);
}
---
int fQQ(void) {
  int table[10];
  int k = 0;
  fscanf(stdin, "%d", &k); //! unchecked_return
  return table[k]; //! oob_read@5
}
---
void fQQ(void) {
  setuid(0); //! unchecked_return
  if (setuid(0) != 0) exit(1);
}
---
void fQQ(void) {
  char big[2097152]; //! excessive_allocation
  char small[128];
}
---
void fQQ(void) {
  chmod("a", 0777); //! incorrect_permissions
  chmod("b", 0700);
  umask(022);
}
---
void fQQ(void) {
  int k[3];
  free(k); //! invalid_free
}
---
void fQQ(void) {
  while (1) { //! infinite_loop
    work();
  }
}
---
void fQQ(int n) {
  while (1) {
    if (n-- < 0) return;
  }
}
---
int fQQ(int n) {
  return n * fQQ(n - 1); //! uncontrolled_recursion
}
---
static void give(char *p) { free(p); }
void fQQ(void) {
  char *p = malloc(4);
  if (!p) return;
  give(p);
  p[0] = 'a'; //! use_after_free@6
}
---
struct n { struct n *next; };
void fQQ(void) {
  struct n *p = NULL;
  p->next = 0; //! null_dereference@4
}
---
void fQQ(void) {
  FILE *f = fopen("a", "r"); //! memory_leak@3
  if (f == NULL) return;
  fputs("x", f);
}
'''

CPP = '''
class OwnQQ {
  char* p;
public:
  OwnQQ() { p = new char[10]; }
  ~OwnQQ() { delete[] p; } //! double_free
};
---
class OwnQQ {
  char* p;
public:
  OwnQQ() { p = new char[10]; }
  OwnQQ(const OwnQQ& o) { p = new char[10]; }
  OwnQQ& operator=(const OwnQQ& o) { return *this; }
  ~OwnQQ() { delete[] p; }
};
---
void fQQ() {
  int* a = new int[3];
  delete a; //! mismatched_free@3
}
---
void fQQ() {
  int* a = new int[3];
  delete[] a;
}
---
void fQQ() {
  int* a = new int(3);
  delete a;
  *a = 4; //! use_after_free@4
}
---
void fQQ() {
  std::string s;
  std::cin >> s;
  system(s.c_str()); //! command_injection@4
}
---
void fQQ() {
  std::string s = "ls";
  system(s.c_str());
}
---
class UseQQ {
  char* q;
public:
  void drop() { delete[] q; }
  char get() { return q[0]; } //! use_after_free@5
};
'''

MARK = re.compile(r"[ \t]*(?://|#)!\s*(.+)$")
SOURCES = ((".py", PYTHON, "#"), (".js", JAVASCRIPT, "//"), (".java", JAVA, "//"), (".cs", CSHARP, "//"), (".c", C, "//"), (".cpp", CPP, "//"))


def _cases() -> tuple[list[tuple[int, str, str, str]], list[tuple[int, int, str, int | None]]]:
    texts, labels = [], []
    for suffix, block, comment in SOURCES:
        for raw in block.strip("\n").split("\n---\n"):
            case, lines = len(texts), []
            # a first line of comment, so that marks may count from one
            for number, line in enumerate([f"{comment} program QQ", *raw.split("\n")], 1):
                m = MARK.search(line)
                for label in m[1].split(",") if m else ():
                    kind, _, source = label.strip().partition("@")
                    labels.append((case, number, kind, int(source) if source else None))
                lines.append(line[: m.start()] if m else line)
            texts.append((case, suffix, comment, "\n".join(lines) + "\n"))
    return texts, labels


CASES, LABELS = _cases()


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def program_view() -> tuple[str, str]:
    """v_program(p_partkey, case_id, pad, filename, text) for Spark and DuckDB: a program for each part."""
    spark_rows = ", ".join(f"({i}, {_spark(s)}, {_spark(c)}, {_spark(t)})" for i, s, c, t in CASES)
    duck_rows = ", ".join(f"({i}, {_quoted(s)}, {_quoted(c)}, {_quoted(t)})" for i, s, c, t in CASES)
    body = """SELECT p_partkey, case_id, CAST(p_size % 5 AS INT) AS pad, 'src/f' || CAST(p_partkey AS STRING) || suffix AS filename,
      replace(repeat(comment || ' filler' || {newline}, CAST(p_size % 5 AS INT)) || body, 'QQ', CAST(p_partkey AS STRING)) AS text
      FROM part JOIN (SELECT * FROM (VALUES {rows}) AS t(case_id, suffix, comment, body)) c ON p_partkey % {n} = case_id"""
    return body.format(rows=spark_rows, n=len(CASES), newline="'\\n'"), body.format(rows=duck_rows, n=len(CASES), newline="chr(10)")


def _spark(text: str) -> str:
    """A Spark string literal; a dollar before a brace is kept from variable substitution."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("${", "$' || '{") + "'"


def label_view() -> str:
    """v_label(filename, line, type, source_line): the findings that the marks ask for."""
    rows = ", ".join(f"({c}, {line}, '{kind}', {'CAST(NULL AS INT)' if s is None else s})" for c, line, kind, s in LABELS)
    return f"""SELECT filename, CAST(l.line + pad AS INT) AS line, l.type, CAST(l.source_line + pad AS INT) AS source_line FROM v_program
      JOIN (SELECT * FROM (VALUES {rows}) AS t(case_id, line, type, source_line)) l ON v_program.case_id = l.case_id"""
