"""Definitions and imports of every language: what counts, what stands in comments and strings, and time on hostile files."""

import time

import pytest

from corvane.operators.definitions import FINDERS
from corvane.operators.extraction import definitions, imports
from corvane.operators.lexer import LANGUAGES, tokens

A = "<anonymous>"
CASES = {
    "typescript": (
        "// function foo() {}\nlet s = \"class Bar\"; /* class Baz */\nclass A<T> extends B {\n  foo(a: number): string {\n    if (a) { return `x${() => 1}` }\n  }\n  bar = (x: T): U => x\n  get z() { return 1 }\n  private async *gen<T>(x): Promise<{a: number}> { while (x) { y() } }\n  over(a: string): void;\n  cb: () => void;\n  ['comp'](x) {}\n  #priv() {}\n}\nabstract class Q { abstract m(): void; n() {} }\ntype F = (a: number) => void\nfunction over(x): void;\nfunction f<T>(x: (y: T) => void): x is T { return 1 }\nconst o = { a: (x) => 1, b(y) { return 2 }, c: function named() {}, async d() {} };\nconst g = async x => { await x }\nexport default function () {}\nfunction* gen() {}\nlet h = function* () {};\nconst t = c ? (b) : d => e;\nfoo(x => y, (z): number => z)\ninterface I { m(a: number): string; k: (x) => void }\nlet v: (a: string) => void = (b) => {};\nlet p = /function no() {}/;\n",
        [("A", 3, 14), ("foo", 4, 6), (A, 5, 5), (A, 7, 7), ("z", 8, 8), ("gen", 9, 9), ("['comp']", 12, 12), ("#priv", 13, 13), ("n", 15, 15), ("f", 18, 18), (A, 19, 19), ("b", 19, 19), ("named", 19, 19), ("d", 19, 19), (A, 20, 20), (A, 21, 21), (A, 23, 23), (A, 24, 24), (A, 25, 25), (A, 25, 25), (A, 27, 27)],
    ),
    "java": (
        "package a;\n@Ann(1)\npublic class A<T extends B> {\n  // void no() {}\n  String s = \"class X { void y() {} }\";\n  private int x = foo(3);\n  @Override\n  public <T> List<T> go(int a, Map<String, List<T>> m) throws E {\n    new Runnable() { public void run() { call(1); } };\n    if (x) { y(); }\n    return null;\n  }\n  A(int q) { super(q); }\n  abstract void no(int x);\n  enum K { P(1), Q(2); K(int i) {} int z() { return 1; } }\n  interface I { int m(); default void d() {} }\n  Object o = A.class;\n}\n@interface Z { int v(); }\nrecord R(int a) { void rr() {} }\n",
        [("A", 2, 18), ("go", 7, 12), ("run", 9, 9), ("A", 13, 13), ("no", 14, 14), ("K", 15, 15), ("z", 15, 15), ("I", 16, 16), ("m", 16, 16), ("d", 16, 16), ("rr", 20, 20)],
    ),
    "c_sharp": (
        "#region x\nnamespace N {\n [Attr(1)]\n public class C : B<int> {\n  public int P { get; set; }\n  int Q => foo(3);\n  public C(int a) : base(a) { }\n  public async Task<int> Do<T>(T x) where T : class { return 1; }\n  int Ex(int a) => a + 1;\n  void I.Exp() {}\n  ~C() {}\n  string s = @\"class \"\"x\"\" { void m() {} }\";\n  delegate void D(int x);\n  public static C operator +(C a, C b) { return a; }\n }\n interface I { void M(); }\n struct S { void InS() {} }\n}\n",
        [("C", 3, 15), ("C", 7, 7), ("Do", 8, 8), ("Ex", 9, 9), ("Exp", 10, 10), ("I", 16, 16), ("M", 16, 16), ("InS", 17, 17)],
    ),
    "go": (
        "package x\n// func no() {}\nfunc F(a int) (b int, err error) {\n\tg := func() {}\n\ttype L struct{}\n\tswitch x.(type) {}\n}\nfunc (t *T) M() {\n}\ntype (\n A int\n B struct { x int }\n)\ntype I interface {\n M()\n}\nfunc Ext(x int)\nvar s = `func no() {}`\n",
        [("F", 3, 7), (A, 5, 5), ("M", 8, 9), (A, 10, 13), (A, 14, 16), ("Ext", 17, 17)],
    ),
    "rust": (
        "pub(crate) struct A<T> where T: X { x: i32 }\nstruct B(i32);\n#[derive(D)]\npub enum E { X }\nunsafe impl<T> Foo for Bar<T> {\n  pub async fn x<'a>(&'a self) -> impl Fn(i32) -> i32 { 1 }\n}\ntrait T { fn sig(&self); fn d(&self) {} }\nmacro_rules! m { () => { fn no() {} } }\nfn main() { let f: fn(i32) = g; println!(\"fn no() {{}}\"); let c = '{'; }\n/* fn a() { /* fn b() {} */ } */\n",
        [("A", 1, 1), ("B", 2, 2), ("E", 4, 4), (A, 5, 7), ("x", 6, 6), ("T", 8, 8), ("d", 8, 8), ("main", 10, 10)],
    ),
    "cpp": (
        "#define F(x) int no(int x) { }\nstatic int *f(int a, char *b) {\n  if (a) { return 0; }\n  struct S s = {1};\n}\nstruct P {\n  int x;\n};\ntypedef struct { int y; } Q;\nint arr[] = {1, 2};\ntemplate <class T>\nclass V : public W<T> {\n public:\n  V(int a) : b_(a), c_{2} { }\n  ~V() {}\n  T get() const { return x; }\n  bool operator==(const V& o) const { return true; }\n  void decl(int);\n};\nenum class Z { A };\nnamespace n { void g() {} }\nint V::h() { return 1; }\nextern \"C\" { int k(void) { } }\nchar *s = \"int q() {}\";\nauto r = R\"x(int no() {} )\" )x\";\n",
        [(A, 2, 5), ("S", 4, 4), ("P", 6, 8), (A, 9, 9), ("V", 12, 19), (A, 14, 14), (A, 15, 15), (A, 16, 16), (A, 17, 17), (A, 21, 21), (A, 22, 22), (A, 23, 23)],
    ),
    "ruby": (
        "# def no; end\nmodule A::B\n  class C < D\n    attr :x if y\n    def f(a, b: 1)\n      if a then b end\n      x = if a\n        1\n      end\n      while a do\n        b\n      end\n      [1].each do |z|\n      end\n      return 1 unless b\n    end\n    def self.s? = 3\n    def ==(o)\n    end\n    class << self\n      def q!\n      end\n    end\n    def w=(v)\n    end\n  end\nend\ns = 'def no'\nt = <<~X\n def no\n end\nX\nobj.class\n=begin\ndef no\n=end\n",
        [("A::B", 2, 27), ("C", 3, 26), ("f", 5, 16), ("s?", 17, 17), ("==", 18, 19), ("q!", 21, 22), ("w=", 24, 25)],
    ),
    "php": (
        "<html> function no() {}\n<?php\n# function no() {}\nfunction f(int $a): ?string { return function() { }; }\nabstract class A extends B {\n  public static function m() { $x = new class { function in() {} }; }\n  abstract function abs();\n}\ninterface I { public function im(); }\n$c = A::class;\n$s = 'class X {}';\n$h = <<<EOT\n function no() {}\nEOT;\n?>\nclass No {}\n",
        [("f", 4, 4), ("A", 5, 8), ("m", 6, 6), ("in", 6, 6), ("abs", 7, 7), ("im", 9, 9)],
    ),
    "kotlin": ("data class A(val x: Int) : B() {\n  fun f() {}\n  companion object {}\n}\nenum class E { X }\nfun interface I { fun m() }\nval k = A::class\n// class No\nclass Z\nval s = \"class ${ \"class Q\" } X\"\n", [("A", 1, 4), ("E", 5, 5), ("I", 6, 6), ("Z", 9, 9)]),
    "swift": (
        "public final class A: B {\n  func f(x: Int) -> Int {\n    return 1\n  }\n  class func g() {}\n  static func == (a: A, b: A) -> Bool { true }\n}\nstruct S { enum K { case a } }\nindirect enum E { case x }\nextension Foo.Bar { func z() {} }\nprotocol P: class { func no() }\nactor Act {}\nlet s = \"\"\"\nclass No {}\n\"\"\"\n",
        [("A", 1, 7), ("f", 2, 4), ("g", 5, 5), ("==", 6, 6), ("S", 8, 8), ("K", 8, 8), ("E", 9, 9), ("Foo.Bar", 10, 10), ("z", 10, 10), ("Act", 12, 12)],
    ),
    "scala": ("trait T {\n  def a: Int\n  def b(x: Int): List[Int]\n  def c(x: Int) = 1\n  def d: Int = 2\n  def e(x: Int)(implicit y: Z): Unit\n}\nclass C { def f() { } }\n", [("a", 2, 2), ("b", 3, 3), ("e", 6, 6)]),
    "python": ("def ok(\n  pass\nclass A:\n    def f(self):\n        return 'def no()'\n    x = 1\ndef broken(:\n", [("ok", 1, 2), ("A", 3, 6), ("f", 4, 5), ("broken", 7, 7)]),
}


@pytest.mark.parametrize("language", CASES)
def test_what_counts(language):
    source, want = CASES[language]
    assert [d[:3] for d in definitions(source, language)] == want
    assert definitions(source.replace("\n", "\r\n").replace("\r\n", "\n"), language) == definitions(source, language)


def test_signatures():
    assert [d[3] for d in definitions("class A { foo(a: number): string {\n } bar = (x: T): U => x }", "tsx")] == ["class A { foo(a: number): string {", "foo(a: number): string {", "(x: T): U => x"]
    assert definitions("void f() {" + " " * 300 + "}", "c")[0][3] == "void f() {" + " " * 190 and definitions("struct A { // x", "c")[0][:3] == ("A", 1, 1)


def test_script_imports():
    source = "// import x from 'no'\nimport a from './a'\nimport type { T } from \"./t\";\nimport 'side'\nimport d, { e as f } from `no`\nexport { b } from \"b\"\nexport * as n from 'n'\nexport const q = 'no'\nconst s = \"import z from 'no'\"\nimport('no')\nrequire('no')\nx.import('no')\nexport type { U } from './u'\n/* export * from 'no' */\n"
    assert imports(source, "typescript") == sorted(["./a", "./t", "./u", "b", "n", "no", "side"])


@pytest.mark.parametrize("language", FINDERS)
def test_time_is_linear(language):
    """Files that aren't closed, or repeat one head, take a few seconds at most a megabyte."""
    for unit in ("/*", '"', "`", "{", "(", "${", "def x\n", "class A { ", "fn a ", "x => ", "f(1) + ", "/[", "<", "int f(int a) ; ", "template <", " " * 300 + "\n", "public   "):
        began = time.time()
        definitions(unit * (60_000 // len(unit)), language)
        assert time.time() - began < 4, unit


def test_strings_nest():
    got = tokens("x = `a ${ {b: `n${1}`} } c`; y = /ab[/]c/g.test(z) / 2", "javascript")
    assert [t for t, k in zip(got.text, got.kind) if k == "s"] == ["`a ${", "`n${", "}`", "} c`", "/ab[/]c/g"]
    assert set(FINDERS) <= set(LANGUAGES) and got.line(0) == 1 and tokens("", "go").text == []
