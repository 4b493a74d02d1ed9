"""Symbols of languages with braces, and the coverage of changed boundaries from two text tables."""

import time

import pytest
from pyspark.sql import functions as F

from linkgrain.functions import text as tx
from linkgrain.functions.lexing import declarations, tokens
from linkgrain.operators import boundaries, extract, rules

LANGUAGES = ("go", "rust", "java", "javascript", "typescript")

SOURCES = {
    "javascript": (
        """// function no() {}
const s = "function x() { {";
/* class Y { */
export async function go(a, {b, c}) { const inner = (q) => { return `t ${ {a:1}.a } }`; }; function nested() {} return /[{]/.test(a) }
const plain = x => x + 1
const notfn = 3, arr = [1, 2].map((x) => { return x })
let obj = { m() { return 1 }, k: function() {} }
class A extends B {
  static x = 1
  #p() { if (a) { b() } }
  async load(a = {}) { for (const z of y) {} }
  get v() { return "}" }
}
export default class {}
""",
        [("function", "go", 4, 4), ("function", "go.inner", 4, 4), ("function", "go.nested", 4, 4), ("function", "plain", 5, 5), ("method", "m", 7, 7), ("class", "A", 8, 13), ("method", "A.p", 10, 10), ("method", "A.load", 11, 11), ("method", "A.v", 12, 12), ("class", "<anonymous>", 14, 14)],
    ),
    "typescript": (
        """export abstract class Repo<T extends {id: string}> {
  private items: Map<string, T> = new Map()
  constructor(private readonly db: Db) {}
  find(id: string): { ok: boolean } | null { return null }
  abstract save(x: T): void;
}
export type Shape =
  | { kind: "a" }
  | { kind: "b" };
type Id = string
interface P { m(): void }
namespace N { export function f() {} enum E { A } }
function over(a: string): string;
function over(a: any): any { return a }
""",
        [("class", "Repo", 1, 6), ("method", "Repo.constructor", 3, 3), ("method", "Repo.find", 4, 4), ("type_alias", "Shape", 7, 9), ("type_alias", "Id", 10, 10), ("interface", "P", 11, 11), ("function", "N.f", 12, 12), ("enum", "N.E", 12, 12), ("function", "over", 14, 14)],
    ),
    "go": (
        """package a
type (
  A struct { X int }
  B interface { M() }
  C = int
)
type G[T any] struct { v T }
func (s *Server[T]) Run(ctx context.Context) (err error) {
  f := func() { x := `}` }
  return nil
}
func Any() interface{} { return struct{ A int }{1} }
var v = func() int { return 1 }
// func not() {}
""",
        [("struct", "A", 3, 3), ("interface", "B", 4, 4), ("struct", "G", 7, 7), ("method", "Server.Run", 8, 11), ("function", "Any", 12, 12)],
    ),
    "rust": (
        """pub(crate) struct P<T> where T: Copy { a: T }
struct Unit;
impl<T: Into<Vec<u8>>> fmt::Display for crate::P<T> where T: Copy {
  fn fmt(&self, f: &mut Formatter<'_>) -> Result { let c = '{'; let l: &'static str = r#"}"#; fn inner() {} }
  pub const fn k() -> usize { 1 }
}
mod m { pub async fn free() {} }
trait D { fn a(&self); fn b(&self) { } }
macro_rules! x { ($a:expr) => { fn no() {} } }
fn gen<F>(f: F) -> impl Fn() where F: Fn() { /* } /* nested } */ */ vec![1]; }
""",
        [("struct", "P", 1, 1), ("struct", "Unit", 2, 2), ("impl", "P", 3, 6), ("method", "P.fmt", 4, 4), ("method", "P.k", 5, 5), ("function", "free", 7, 7), ("trait", "D", 8, 8), ("method", "D.b", 8, 8), ("function", "gen", 10, 10)],
    ),
    "java": (
        """package x;
@Entity(name = "{")
public final class A<T> extends B implements C {
  private int x = foo(1);
  private final Map<String, List<T>> m = new HashMap<>() { { put("}", null); } };
  @Override @Deprecated(since = "1")
  public <R> List<R> map(Function<T, R> f) throws E { return null; }
  A(int x) { this.x = x; }
  abstract void g();
  enum M { ON(1) { void h() {} }, OFF; M(int i) {} int v() { return 1; } }
  record R(int a) { int twice() { return 2 * a; } }
  @interface Ann { int value() default 1; }
}
""",
        [("class", "A", 2, 13), ("method", "A.map", 6, 7), ("constructor", "A.A", 8, 8), ("method", "A.g", 9, 9), ("enum", "A.M", 10, 10), ("method", "A.M.h", 10, 10), ("constructor", "A.M.M", 10, 10), ("method", "A.M.v", 10, 10), ("method", "A.twice", 11, 11)],
    ),
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_declarations(language):
    text, want = SOURCES[language]
    assert [(x.kind, x.name, x.s, x.e) for x in declarations(text, language)] == want


@pytest.mark.parametrize("language", LANGUAGES)
def test_layout_changes_no_hash_and_a_value_does(language):
    text, _ = SOURCES[language]
    hashes = {(x.kind, x.name): x.hash for x in declarations(text, language)}
    looser = "\n".join(" " * (k % 3) + line + "  // note {" for k, line in enumerate(text.splitlines()) if "*/" not in line)
    again = {(x.kind, x.name): x.hash for x in declarations(looser + "\n", language)}
    assert again and all(hashes[k] == h for k, h in again.items())
    other = {(x.kind, x.name): x.hash for x in declarations(text.replace("return", "return 9 +"), language)}
    same = {k for k in other if other[k] == hashes[k]}
    assert len(same) < len(hashes) or "return" not in text
    names = [t.text for t in tokens(text, language)]
    assert "no" not in [n for k, n in zip(names, names[1:], strict=False) if k in ("function", "class")]


@pytest.mark.parametrize("language", LANGUAGES)
@pytest.mark.parametrize("junk", ["{", "}", "[{(", "fn a ", "func a ", "function a ", "class a ", "impl a ", "const a: ", "const a = <", "type a = b |\n", '"', "`${", "/*", 'r#"', "async ", "a(b)\n", "export class A {", "module a ", "@ ", "=/[", "record a(", "'"])
def test_unbalanced_texts_take_linear_time(language, junk):
    began = time.perf_counter()
    found = declarations(junk * 1500, language)
    assert time.perf_counter() - began < 4 and len(found) <= 1500


def test_qualified_names_and_blocks(spark):
    files = spark.createDataFrame([("src/app/a.ts", "typescript", "class A {\n  m() { return 1 }  \n}\n"), (".x/b", "go", "func F() {}\n"), ("c.py", "python", "class P:\n    def q(self):\n        pass\n")], "path string, language string, text string")
    rows = {r.qualified: r for r in extract.symbols(files).join(files, "path").withColumn("own", tx.fingerprint(F.array_join(F.slice(tx.lines(F.col("text")), F.col("s"), F.col("e") - F.col("s") + 1), "\n"))).collect()}
    assert sorted(rows) == [".x.b.F", "c.P", "c.P.q", "src.app.a.A", "src.app.a.A.m"] and all(r.own == r.block for r in rows.values())


NOW = {
    ("a.py", "python"): "# trace:v1 id=impl.a\n@deco\ndef marked():\n    return 1\n\n\ndef fresh():\n    return 2\n\n\n# trace:exempt reason=helper\ndef helper():\n    return 3\n\n\n# trace:exempt reason=\ndef bare():\n    return 4\n\n\ndef same():\n    return 5\n\n\ndef edited():\n    return 6\n",
    ("b.go", "go"): "// trace:v1 id=impl.s\ntype S struct {\n  // trace:inherit impl.s reason=part\n  X int\n}\n\n// trace:v1 id=impl.s\n\nvar x = 1\nfunc Far() {}\n",
    ("c.ts", "typescript"): "// trace:v1 id=impl.c\nclass C {\n  // trace:inherit impl.c reason=part\n  one() {}\n  // trace:inherit impl.other reason=part\n  two() {}\n  // trace:inherit impl.c\n  three() {}\n}\n",
    ("d.md", "markdown"): "# REQ-1 Title\ntext\n## Plain\n\n<!-- trace:v1 id=doc.p -->\n## Prose\nwords\n<!-- trace:v1 id=doc.q -->\n## Old\nmore\n",
    ("e.yaml", "yaml"): "# trace:v1 id=config.a\na: 1\nb:\n  deep: 2\n\nc: 3\n",
    ("f.json", "json"): '{\n "one": 1,\n "two": {"one": 3}\n}\n',
}
BEFORE = {("a.py", "python"): "def same():\n    return 5\n\n\ndef edited():\n    return 0\n", ("d.md", "markdown"): "# Old\nless\n", ("e.yaml", "yaml"): "c: 3\nb:\n  deep: 7\n", ("f.json", "json"): "{"}


def test_changed_boundaries_from_texts(spark):
    table = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "path string, language string, text string")
    nodes = spark.createDataFrame([("impl.c", "c.ts", True), ("impl.other", "c.ts", True), ("impl.s", "b.go", False)], "trace_id string, path string, active boolean")
    cars = spark.createDataFrame([("f.json", "two", 4)], "path string, key string, line int")
    rows = boundaries.untraced_changes(table(NOW), table(BEFORE), nodes, cars).collect()
    got = {(r.path, r.name): (r.line, r.changed, r.traced) for r in rows}
    assert got == {
        ("a.py", "marked"): (2, True, True), ("a.py", "fresh"): (7, True, False), ("a.py", "helper"): (12, True, True), ("a.py", "bare"): (17, True, False), ("a.py", "same"): (21, False, None), ("a.py", "edited"): (25, True, False),
        ("b.go", "S"): (2, True, True), ("b.go", "Far"): (10, True, False),
        ("c.ts", "C"): (2, True, True), ("c.ts", "C.one"): (4, True, True), ("c.ts", "C.two"): (6, True, False), ("c.ts", "C.three"): (8, True, False),
        ("d.md", "REQ-1 Title"): (1, True, True), ("d.md", "Plain"): (3, True, True), ("d.md", "Prose"): (6, True, True), ("d.md", "Old"): (9, False, None),
        ("e.yaml", "a"): (2, True, True), ("e.yaml", "b"): (3, False, None), ("e.yaml", "c"): (6, False, None),
        ("f.json", "one"): (2, True, False), ("f.json", "two"): (3, True, True),
    }
    ctx = rules.Context(nodes, spark.createDataFrame([], "f string, p string, t string"), boundaries=boundaries.untraced_changes(table(NOW), table(BEFORE), nodes, cars), exclusions=["c.*"])
    assert sorted((r.path, r.line) for r in rules.untraced_boundary(ctx).collect()) == [("a.py", 7), ("a.py", 17), ("a.py", 25), ("b.go", 10), ("f.json", 2)]
    assert boundaries.untraced_changes(table(NOW).limit(0), table(BEFORE), nodes).count() == 0


def test_texts_are_read_once_and_nodes_only_if_a_boundary_asks_for_them(spark):
    reads = spark.sparkContext.accumulator(0)
    code = spark.createDataFrame([(f"{n}.go", "go", f"// trace:v1 id=impl.{n}\f\n\n\nfunc F() {{\n\n}}\nfunc G() {{}}\n") for n in range(3)], "path string, language string, text string")
    now = code.withColumn("text", F.udf(lambda text: reads.add(1) or text, "string")("text"))
    nodes = spark.range(3).select(F.lit("x").alias("trace_id"), F.concat("id", F.lit(".go")).alias("path"), F.expr("raise_error('read')").cast("boolean").alias("active"))
    rows = boundaries.untraced_changes(now, code.filter("path = '0.go'"), nodes).collect()
    assert sorted(rows) == [("0.go", n, "function", s, False, None) for n, s in (("F", 4), ("G", 7))] + [(f"{k}.go", n, "function", s, True, n == "F") for k in (1, 2) for n, s in (("F", 4), ("G", 7))]
    assert reads.value == 3


def test_template_that_ends_in_a_backslash():
    assert [x.name for x in declarations("function a() { return 1 }\nconst b = `\\", "typescript")] == ["a"]
