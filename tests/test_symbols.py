"""Symbols of small sources by hand."""

import pytest

from thicket.operators import symbols

RUST = '''//! doc { fn fake() {
#[derive(Debug, Clone)]
pub struct Point<T> { pub x: T, y: T }
/* fn no() { /* nested } */ { */
pub(crate) enum E { A, B(i32) }
pub trait Shape: Sized { fn area(&self) -> f64; fn name(&self) -> String { "} fn z() {".to_string() } }
impl<T: Into<HashMap<u8, u8>>> Shape for Point<T> where T: Copy {
    fn area(&self) -> f64 { let c = '{'; if true { 1.0 } else { 2.0 } }
}
mod inner { pub async fn go<'a>(a: &'a str, mut b: Vec<(u8, u8)>, f: fn(u8) -> u8) -> Result<(), Error> { struct S; } pub const MAX: [u8; 2] = [1, 2]; }
static mut N: i32 = 3;
pub type Alias = Vec<u8>;
const R: &str = r#"fn raw() { " "#;
'''
TYPESCRIPT = '''export class A<T> extends B { #x = 1; constructor(private a: number, b?: Map<string, number>) { super() }
  async load(url: string): Promise<void> { if (url) { fetch(url) } }
  private hide() {} static make = 1
}
export const add = (a: number, b = 2): number => { return a + b }
const re = /[{]"/g, t = `x ${1} {`
let count = 4 / 2
function* gen(...rest) { const local = 1
  function nested(q) {} }
export default function main() {}
export interface I { f(a: string): void }
namespace N { export enum Color { Red } }
export type T1 = string | number
foo(function () { const inner = 2; class K {} })
'''
GO = '''package main
import ("fmt")
const Max = 3
var name = "func x() {"
type Server struct { a int; b []string }
type Doer interface { Do(x int) error }
func (s *Server) Handle(w http.ResponseWriter, r *http.Request) (int, error) {
	for i := 0; i < 3; i++ { fmt.Println("}", '{') }
	return 1, nil
}
func helper[T any](a, b int) error { return nil }
type ID int
'''
JAVA = '''package x;
@Deprecated(since = "1")
public abstract class Outer<T> implements Runnable {
  private int[] a = {1, 2};
  public Outer(int x) { super(x); }
  @Override public <R> java.util.List<R> get(final Map<String, List<R>> m, String... more) throws IOException { if (a) { foo(1); } return null; }
  abstract void todo();
  protected static class Inner { void run() { new Thread() { public void go() {} }; } }
  enum Color { RED(1), BLUE; Color(int x) {} }
}
interface Api { String call(int a); }
/* class No { } */ // class Neither {
'''
PYTHON = '''import x
class A(B):
    """doc def no(): """
    @property
    def f(self, a: int = (1, 2), *args, **kw) -> int:
        if a:
            def inner(): pass
        return {
  "a": 1}
    async def _g(self): ...
def top(a,
        b=[1,2]):
    return 1
x = 1
'''
WANT = {
    "rust": "pub Point struct; crate E enum; pub Shape trait; - Shape::area method self f64; - Shape::name method self String; - Point::area method self f64; - inner module; pub inner::go function a,b,f Result; - inner::S struct; pub inner::MAX constant; - N constant; pub Alias type; - R constant",
    "typescript": "pub A class; pub A.constructor method a,b; pub A.load method url Promise; - A.hide method; pub add function a,b number; - re constant; - count variable; - gen function rest; - nested function q; pub main function; pub I interface; pub I.f method a void; - N module; pub N.Color enum; pub T1 type; - K class",
    "go": "pub Max constant; - name variable; pub Server struct; pub Doer interface; pub (s*Server).Handle function w,r (int, error); - helper function a,b error; pub ID type",
    "java": "pub Outer class; pub Outer.Outer method x; pub Outer.get method m,more java.util.List; internal Outer.todo method  void; protected Outer.Inner class; internal Outer.Inner.run method  void; internal Outer.Color enum; internal Outer.Color.Color method x; internal Api interface; internal Api.call method a String",
    "python": "pub A class; pub A.f method self,a,args,kw int; pub A.inner function; - A._g method self; pub top function a,b",
}
SOURCES = {"rust": RUST, "typescript": TYPESCRIPT, "go": GO, "java": JAVA, "python": PYTHON}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, k, v) for k, v in SOURCES.items()] + [("broken", "rust", "fn a() { ("), ("none", None, "fn a() {}"), ("null", "go", None), ("other", "cobol", "fn a() {}"), ("empty", "java", ""), ("open", "java", 'class A { String s = "x'), ("crlf", "javascript", "class A {\r\n  m() {}\r\n}\r\nfunction b() {}\r\n")]
    frame = spark.createDataFrame(rows, "name string, language string, source string").selectExpr("name AS kind", "language", "source", "1 AS line")
    out = {}
    for r in symbols.extract(frame.withColumnRenamed("kind", "file").withColumnRenamed("line", "extra")).collect():
        out.setdefault(r["file"], []).append(r)
    return out


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_symbols_by_hand(found, language):
    short = {"public": "pub", "private": "-"}
    got = sorted(" ".join([short.get(r["visibility"], r["visibility"]), r["path"], r["kind"], ",".join(r["parameters"]), r["return_type"] or ""]).strip() for r in found[language])
    assert got == sorted(WANT[language].split("; ")) and all(r["balanced"] for r in found[language])


def test_lines(found):
    assert {(r["path"], r["line"], r["end_line"]) for r in found["java"]} >= {("Outer", 2, 10), ("Outer.get", 6, 6)}
    assert ("top", 11, 13) in {(r["path"], r["line"], r["end_line"]) for r in found["python"]}


def test_odd_sources(found):
    assert [(r["path"], r["balanced"]) for r in found["broken"]] == [("a", False)]
    assert [(r["path"], r["balanced"]) for r in found["open"]] == [("A", False)]
    assert [r["path"] for r in found["crlf"]] == ["A", "A.m", "b"]
    assert not {"none", "null", "other", "empty"} & set(found)


def test_long_sources(spark):
    """Strings, nests and files of any length."""
    rust = 'const A: &str = "' + "\\\\x" * 400_000 + '";\n' + "".join(f"mod m{k} {{ " for k in range(300)) + "fn deep() {}" + " }" * 300 + "\nfn f(" + ", ".join(f"a{k}: Vec<(u8, u8)>" for k in range(3000)) + ") {}\n"
    rows = {r["name"]: r for r in symbols.extract(spark.createDataFrame([("rust", rust)], "language string, source string")).collect()}
    assert rows["A"]["kind"] == "constant" and rows["deep"]["path"].count("::") == 300 and len(rows["f"]["parameters"]) == 3000


def test_heads_that_declare_nothing_stay_in_the_scanner():
    """Statements of bodies were sent to the columns too: six heads a function, of which one declares something."""
    for language, head in (("rust", "fn"), ("go", "func"), ("javascript", "function")):
        _, rows = symbols.Scanner(language).run(head + " f(a) { s = 1\n if (s > 1) { return g(1) } else { return 2 } }\n")
        assert [r["head"] for r in rows] == [f"{head} f (0)"]
