import ast
import contextlib
import io
import random
import re
import warnings

import pytest

from loamlens.llm.grammar import GRAMMARS, adjacent, permissible
from loamlens.llm.lexer import ERROR, lex
from loamlens.llm.syntax import bad_clauses, folded, parse_rates, unparsable

SCHEMA = "file_id long, repo string, path string, lang string, content string, codes string, unit long"
GOOD = {
    "a.py": ["", "x = 1\n", "def f(a, *, b=2) -> int:\n    '''d'''\n    return a if b else [i for i in a]\n", "if a:\n    pass\nelif b: pass\nelse:\n\n    # c\n    x = {'a': 1,\n 'b': 2}\n", "s = '''\n<<<<<<< HEAD\n'''\n", "class A(B):\n    @p\n    async def f(self): yield 1\n", "x = f\"{a!r}:{b}\" 'c'\nprint(f'{x}', end='')\n", "try:\n\tx\nexcept* (A, B) as e:\n\traise X from e\nfinally:\n\tdel x\n", "match x:\n    case [1, *r] if r: pass\n    case _:\n        y = lambda q, /, *a, **k: (yield)\n", "with (a as b, c):\n    x: int = 0x1F + 1_000j\nwhile (n := f()) != 3: n **= 2\n", "\ufeffx = a[1:2, ::3]\r\ny = not x is not None\r\n", "x = 5 \\\n  + 6\n"],
    "a.js": ["", "let a = 1\nlet b = a\n", "const f = async (x, {y = 1, ...z}) => { return `a${x ? `b${y}` : 'c'}d` };", "/[({]\\d+[})]?/g.exec(a) / 2;", "for (let i = 0, j; i < n; i++) { if (a) continue; else break }", "import x, { y as z } from 'm'\nexport default class A extends B { static #p = 1; get v() { return this.#p } }\n", "/*\n<<<<<<< HEAD\n*/ x?.y?.[0] ?? {}", "switch (a) { case 'x': return 1\n default: f() }", "a = { if: 1, class: 2, 'x': 3, [k]: 4, f() {}, async *g() {} }", "label: do { x++ } while (x < 3)\ntry { f() } catch { } finally { }"],
    "a.ts": ["", "export function f<T extends A>(a: Map<string, T[]>, b?: number): asserts a is X { return a as unknown as Record<string, T> }", "interface A extends B { readonly a: string; [k: string]: any; f?(x: number): void }\ntype U = 'a' | 'b'\nenum E { A = 1, B }", "abstract class A<T> implements I { constructor(private readonly x: number) { super() } abstract g(): void; y!: string }", "const x: Array<{ a?: number }> = [...y!].map((v): v is string => true)"],
    "a.go": ["package p\n", "package p\n\nimport (\n\t\"a\"\n\tb \"c\"\n)\n\nfunc (r *T) F(a []string, b ...int) (x int, err error) {\n\tif v, ok := m[\"k\"]; !ok {\n\t\treturn\n\t} else if v > 1 {\n\t\tgo func() { <-c }()\n\t}\n\tfor i := range a {\n\t\tx += i\n\t}\n\ts := `\n<<<<<<< HEAD\n`\n\tswitch {\n\tcase a == nil:\n\tdefault:\n\t}\n\treturn T{A: 1, B: []int{1, 2}}, nil\n}\n", "package p\ntype A struct {\n\tB\n\tX, Y int `json:\"x\"`\n}\ntype I interface{ F(int) string }\nvar f = map[string]func(int) error{}\n"],
    "a.rs": ["", "use a::{b, c::*};\n#[derive(Debug, Clone)]\npub struct S<'a, T: Clone> { x: &'a [T], y: Vec<u8> }\nimpl<'a, T: Clone> S<'a, T> { pub fn f(&mut self, n: usize) -> Option<T> { let v: Vec<usize> = (0..402).filter(|v| v % 3 == 0).collect(); match n { 0 | 1 => None, _ if n > 2 => { Some(self.x[0].clone()) } _ => todo!(\"x\"), } } }", "/* a /* b */ ( */ fn main() { println!(\"{}\", '{'); let c = b'\\n'; for i in 0..=3 { if let Some(x) = y? { break; } } }", "pub const A: &str = r#\"<<<<<<< \"x\"\"#;"],
    "A.java": ["package a.b;\nimport java.util.*;\npublic class A<T extends B> extends C implements D {\n  private static final int X = 1;\n  @Override public Map<String, Integer> f(final List<String> a, int... b) throws E { for (int i = 0; i < 3; i++) { a.add(i); } Runnable r = () -> { g(); }; return b == null ? null : (T) x.stream().filter(v -> v != null).toList(); }\n}\n", "enum E { A(1), B; int x; E() {} }\nrecord R(int a) {}\ninterface I { default void f() { int[] a = {1, 2}; char c = '\\''; String s = \"\"\"\n  <<<<<<< \"x\"\n  \"\"\"; } }"],
}
BAD = {
    "a.py": ["def f(a)\n    return a\n", "def f(a, b:\n    return a\n", "if a:\n", "x = 'abc\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "if a:\n        x\n    y\n", "x = 1\n    y = 2\n", "const x = 1;\n", "x = 06c3\n", "'''open\n", "x = )\n", "select a from b\n", "x = (1]\n"],
    "a.js": ["function f( {", "let x = ;", "const a = 'b\n", "<<<<<<< HEAD\nf()\n=======\ng()\n>>>>>>> b\n", "function f(a: string) { return a }", "def f(x):\n    pass\n", "if (a { b }", "f()}\n", "import { a } from", "package main\n\nfunc main() {}\n", "let a = `x", "[a]\nlimit = 19 bytes\n", "interface A { x: number }", "/* open"],
    "a.ts": ["export const = 1;", "class A { f( { } }", "x = [1, 2;\n", "from x import y\n", ">>>>>>> main\n"],
    "a.go": ["", "package p\nfunc f( {\n}\n", "package p\nconst x =\n", "import { a } from 'b'\n", "package p\nfunc f() { s := \"a\n }\n"],
    "a.rs": ["fn f( {}", "fn f() -> usize { let x = ; }", "fn f() { \"abc }", "use a::b", "package p\n", "/* /* */ fn f() {}"],
    "A.java": ["public class A { void f( { } }", "class A { int x = 1 }", "class A { String s = \"a; }", "import { a } from 'b';", "<<<<<<< HEAD\nclass A {}\n", "class A { void f() { } ", "export function f(a) { return a; }", "fn f() -> usize { 1 }"],
}


# A clause, head or arm is wrong while all pairs of tokens and all brackets are right.
GOOD_CLAUSES = {
    "a.js": ["if (a) b()\nelse c()\n", "if (a) { }\nelse if (b) { }\nelse { }\n", "for (const [k, {v}] of list) f(k)\nfor (const k in o) { }\nfor (;;) { }\nfor (let i = 0, n = (2); i < n; i++) g()", "if (a) if (b) c(); else d(); else e()\n", "x.catch(f).finally(() => { g() })\ntry { f() } finally { g() }", "switch (a) {\n case 1: { f() } break\n case 'b':\n default: if (x) { } else { }\n}\nconst o = { default: 1, case: 2, else: 3 }", "if (a) f(function () { if (b) { } else { } }); else g()"],
    "a.ts": ["if (a) { } else { }\nfor (const x of y as Z[]) { }\ntry { } catch { }"],
    "A.java": ["class A { void f() throws E { if (a) { } else if (b) c(); else { } for (int x : xs) g(); for (var e : m.entrySet()) { } for (int i = 0, j = f(1, (2)); i < j; i++) { } try (R r = g(); S s = h()) { } try (r) { k(); } finally { } int y = switch (x) { case 1 -> 2; default -> { yield 3; } }; Runnable q = () -> { if (a) return; else b(); }; } }"],
    "a.go": ["package a\nfunc f() {\n if v, ok := m[k]; ok {\n } else if v > 1 {\n } else {\n }\n for i := 0; i < len(xs); i++ {\n }\n for {\n }\n for ; x < 3; {\n }\n for k, v := range m {\n }\n if err := g(func() { h() }); err != nil {\n } else {\n }\n select {\n case x := <-c:\n  y := x\n default:\n }\n switch t := v.(type) {\n case int:\n }\n switch x := f(); x {\n case 1:\n }\n a, b = b, a\n}\n"],
    "a.rs": ["fn f() { let Some(x) = g() else { return; }; let y = if a { 1 } else if b { 2 } else { 3 }; match x { A if y => if z { 1 } else { 2 }, B => { g(); } _ => [0; 4].len(), } let h: Vec<Box<dyn Iterator<Item = u8>>> = k; let c = |q: u8| q; if let A { b: 1, .. } = d { } else { } }"],
}
BAD_CLAUSES = {
    "a.js": ["for (let i = 0; i < 3) { }", "for (let i = 0; i < 3; i++; f()) { }", "for (let i) { }", "else { f(); }", "f()\nelse { g() }", "if (a) { } else { } else { }", "try { g(); }\nh()", "f()\ncatch (e) { }", "case 1: f()", "switch (a) { f(); case 1: }", "const f = function (a: string) { }"],
    "a.ts": ["for (let i = 0; i < 3) { }", "try { g(); }", "while (a) { f(); else { g(); } }"],
    "A.java": ["class A { void f() { for (int i = 0; i < 3) { } } }", "class A { void f() { try { g(); } h(); } }", "class A { void f() { { g(); else { h(); } } } }", "class A { void f() { for (int x) { } } }"],
    "a.go": ["package a\nfunc f() {\n for i := 0; i < 10 { }\n}\n", "package a\nfunc f() {\n x := y := z\n}\n", "package a\nfunc f() {\n for x {\n } else {\n }\n}\n"],
    "a.rs": ["fn f() { g(); } else { h(); }", "fn f() { match x { 1 => 2; 2 => 3 } }", "fn f() { let x: u8 = 1 = 2: 3; }", "fn f() { while a { } else { } }"],
}


def cases(table):
    return [(path, code) for path, codes in table.items() for code in codes]


def flagged(spark, rows):
    df = spark.createDataFrame([(i, "r", path, None, code, "x", 1) for i, (path, code) in enumerate(rows)], SCHEMA)
    return {r.file_id for r in unparsable(df).collect()}


def test_valid_code_is_no_case(spark):
    rows = cases(GOOD) + cases(GOOD_CLAUSES)
    assert [rows[i] for i in flagged(spark, rows)] == []


def test_invalid_code_is_a_case(spark):
    rows = cases(BAD) + cases(BAD_CLAUSES)
    found = flagged(spark, rows)
    assert [r for i, r in enumerate(rows) if i not in found] == []


def test_python_files_against_its_own_parser(spark, sf):
    files = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/files.parquet").where("path LIKE '%.py' OR path LIKE '%.pyi'")
    found = {r.file_id for r in unparsable(files).collect()}
    warnings.simplefilter("ignore")
    wrong = set()
    for r in files.where("content IS NOT NULL").select("file_id", "content").collect():
        try:
            ast.parse(r.content)
        except (SyntaxError, ValueError):
            wrong.add(r.file_id)
    assert found == wrong and wrong


def test_cut_python_files_against_its_own_parser(spark, sf):
    rng = random.Random(9)
    texts = [r.content for r in spark.read.parquet(f"{sf}/files.parquet").where("path LIKE '%.py' AND content <> ''").collect()]
    rows = [("x.py", t[: rng.randrange(1, len(t))]) for t in texts for _ in range(3)]
    found = flagged(spark, rows)
    for i, (_, code) in enumerate(rows):
        try:
            ast.parse(code)
            assert i not in found, code[-80:]
        except SyntaxError:
            assert i in found, code[-80:]


def test_null_unknown_repeated_and_empty(spark):
    rows = [(1, "r", "a.py", None, "x = (", "", 1), (1, "r", "a.py", None, "x = (", "", 1), (2, "r", "a.py", None, None, "", 1), (3, "r", "a.md", None, "x = (", "", 1), (4, None, None, None, "x = (", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.file_id for r in unparsable(df).collect()] == [1]
    assert [(r.n_files, r.n_unparsable, r.share) for r in parse_rates(df).collect()] == [(1, 1, 1.0)]
    assert unparsable(df.where("false")).count() == 0


@pytest.mark.parametrize("lang", sorted(GRAMMARS))
def test_grammars_leave_most_pairs_out(lang):
    tokens = {t for p in adjacent(GRAMMARS[lang]) for t in p}
    assert len(permissible(lang)) < 0.9 * len(tokens) ** 2
    assert "nn" not in permissible(lang) or lang in ("java", "go")


def test_open_texts_are_errors():
    assert ERROR in lex("py", "x = 'a") and ERROR in lex("js", "/* a") and ERROR in lex("go", "`a") and ERROR in lex("rs", "/* /* */")


def test_code_generated_for_the_clauses_is_short_enough_to_be_compiled(spark):
    """The JVM leaves methods of more than 8000 bytes interpreted; all rules in one method had 11023."""
    lexed = folded(spark.createDataFrame([(1, 1, "js", "\x02\x03")], "unit long, file_id long, lang string, codes string")).localCheckpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    shown = io.StringIO()
    try:
        with contextlib.redirect_stdout(shown):
            bad_clauses(lexed).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 8000
