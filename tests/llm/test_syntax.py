import ast
import json

import pytest

from strataloom.llm import syntax as X
from strataloom.llm.derivatives import Grammar

GOOD = {
    "json": ["{}", "[]", ' {"a": [1, -2.5e3, true, null, "x\\u00e9\\n"], "b": {"c": ""}} ', '"s"', "0"],
    "python": [
        "", "\n\n# c", "x = 1", "x: int = 1\ny += 2; z = (yield)\n",
        "@a.b(1)\nasync def f[T: int](a, /, b: int = 2, *c, d=3, **e) -> int:\n    '''doc'''\n    async with a as b, c:\n        await d\n    return [x async for x in y if x if z]\n",
        "class A(B, metaclass=C):\n    x = 1\n    def f(self):\n\n  # odd comment\n        return self.x[1:2, ::3, ...]\n",
        "if a:\n\tb\nelif c: d\nelse:\n  e\n", "try:\n  a\nexcept* (B, C) as d:\n  e\nelse:\n  f\nfinally:\n  g\n",
        "match x:\n  case [1, *_] | {'a': b, **c} if d: pass\n  case A(b=1): pass\n  case _: pass\nmatch = type = case = 1\n",
        "with (open(a) as b, c): pass\n", "a = b = c, *d = lambda x, *y, z=1: (x := 2)\n", "f(*a, **b, c=1, d=(i for i in x))\n", "x = not -~a ** b if c else d\n",
        "print(f'{a!r:>{w}}' u'' \"\"\"x\ny\"\"\")\n", "del a[0], b.c\nglobal_ = 0x_ff + 1_0.5e-3j\n", "from . import (a as b, c,)\nfrom ...x.y import *\n", "x = [\n  1,\n\n    # c\n  2]\n", "a = b \\\n  + c\n",
        "for a, (b, c) in d:\n  continue\nelse:\n  pass\n", "x = {**a, 'b': 1}; y = {1, *z}; w = {a: b for a in c}\n", "raise A from B\nassert a, b\n", "type X[T] = list[T]\n",
    ],
    "go": [
        "package a\n", "package a\n\nimport (\n\t\"x\"\n\t. \"y\"\n\tz \"z\"\n)\n",
        "package a\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tx.Y\n}\n\ntype I interface {\n\tF(a int, b ...string) (c int, err error)\n\t~int | ~string\n}\n",
        "package a\n\nfunc (t *T) f(a, b int, c func(int) error) (x []map[string]*T) {\n\tif v, ok := m[k]; ok && !v {\n\t\treturn nil\n\t} else if x == (T{1}) {\n\t}\n\tfor i := 0; i < 10; i++ {\n\t\tcontinue\n\t}\n\tfor k, v := range m {\n\t\tdefer g(k, v...)\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v := <-c:\n\t}\n\tgo func() { ch <- struct{}{} }()\n\tz := map[string][]int{\"a\": {1, 2}, \"b\": nil}\nL:\n\tgoto L\n}\n",
        "package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y = 1, 0x1p-2\nvar r rune = '\\n'\nvar c = []byte(\"x\")[1:2:3]\n", "package a; func f() { x := G[int, string](1); _ = x }\n",
    ],
    "javascript": [
        "", "let a = 1, {b, c: [d = 2, ...e], ...f} = g\nconst h = async (x, {y} = {}) => ({z: await x})\n", "import a, {b as c, default as d} from 'x'; import * as e from 'y'; import 'z'\nexport {a, b as default}; export * as q from 'r'; export default class {}\n",
        "class A extends (b, c) { static #x = 1; static { this.y = 2 } get z() { return this.#x } async *[q]() { yield* w } constructor(a = 1, ...b) { super(a) } 'm'() {} }",
        "for (const [a, b] of c) if (a) continue; else break\nfor (let i = 0, n = 1; i < n; i++) {}\nfor (var k in o);\nfor await (x of y) z()\n", "a\n++b\nreturn_ = /re[/]x/g.test(s) ? 1 / 2 : `t${a + `u${b}`}v`\n", "x = a?.b?.[c]?.(d) ?? e; y **= 2; z ||= new F; w = new (G())(1).h`t`\n",
        "switch (a) { case 1: case 2: { f() } default: g() }\ntry { a } catch { b } finally { c }\nl: do { x } while (y) z\n", "var f = function* g(a) { const b = yield a; return }\n", "if (a) { b } else c\n;[1, , 2].map(x => { return x })\n", "{{ a.b }}",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D<T>, E { readonly a?: string; b(c: number): void; [k: string]: any; new (x: T): A<T>; get x(): number }",
        "type M<T> = { readonly [K in keyof T as `x${string & K}`]?: T[K] extends infer U ? U[] : never } & (new () => T) | [a: string, ...b: number[]]",
        "export abstract class A<T> extends B<T> implements C, D { constructor(private readonly a: string, public b?: number) { super() } protected abstract f(): void; static x!: Map<string, Array<Set<number>>>; g<U>(this: A<T>, u: U): u is string { return u! as any satisfies unknown } }",
        "declare module 'x' { export const y: number; function f(a: string): void; function f(a: number): void }\nenum E { A = 1, B = 'b' }\nnamespace N.M { let z = <any>1 }\n", "import type { A } from 'a'; import fs = require('fs'); export type { B } from './b'; export = fs\n", "@dec() class A { @inn() x = f<number>(a >> 2, b >>> 1) }\n", "const f = <T,>(x: T): T => x, g = async (a?: number): Promise<void> => {}\nlet u: unique symbol, v: typeof import('x'), t = [1] as const\n", "abstract = type + declare\nfor (const x of y as Z[]) {}\n",
    ],
}
BAD = {
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", "[1 2]", "01", "NaN", '{"a": 1} x', '"a\nb"', "// c\n{}", '"\\x"', "[1,]", "tru"],
    "python": ["def", "def f(:\n  pass\n", "if a:\nb\n", "x = (1\n", "  x\n", "if a:\n    b\n  c\n", "<<<<<<< HEAD\n", "print 'x'\n", "x = 'a\n", "class {{ a.b }}:\n  pass\n", "try:\n  a\n", "f(a b)\n", "a = 012\n", "x = 1 +\n", '"""abc', "else:\n  a\n", "return = 1\n", "f() = 1\n", "import a.\n", "x ? y\n"],
    "go": ["", "x := 1\n", "package a\nfunc f() {\n", "package a\nfunc f() { x := }\n", "package a\n<<<<<<< HEAD\n", "package a\nvar x = \"a\n", "package a\nx := 1\n", "package a\nfunc f(a int {}\n", "package a\nvar x = []int{\n1,\n2\n}\n", "package a\nfunc f() { for i := 0; i < 3 { } }\n", "package a\nfunc {{ x }}() {}\n", "package a\nimport x\n"],
    "javascript": ["{", "function (a) {}", "let x = ;", "const x;", "<<<<<<< HEAD\na", "a b", "function {{ x }}() {}", "x = {{ a.b }};", "`abc", "'a\n'", "return 1", "let x: number = 1", "interface A {}", '{"a": 1, "b": 2}', "for (;;", "if a {}", "import {a} fro 'b'", "f(a,,b)", "class A { x y }", "def f():\n  pass"],
    "typescript": ["let x: = 1", "interface A { a: }", "type A = |", "function f(a: number { }", "class A { private }  }", "<<<<<<< HEAD\n", "enum { A }", "let x = {{ a }}", '{"a": 1}', "package a\n\nfunc f() {}\n"],
}


@pytest.mark.parametrize("lang", X.LANGUAGES)
def test_valid(lang):
    for text in GOOD[lang]:
        assert X.language(lang).failure(text) is None, text
        if lang == "python":
            ast.parse(text)


@pytest.mark.parametrize("lang", X.LANGUAGES)
def test_invalid(lang):
    for text in BAD[lang]:
        assert X.failure(text, lang) is not None, text


@pytest.mark.parametrize("lang", X.LANGUAGES)
def test_truncated(lang):
    """A file cut within a construct fails at its end."""
    longest = max(GOOD[lang], key=len)
    if lang == "python":
        # cutting Python may leave a valid file; the two readers must agree
        for n in range(0, len(longest), 3):
            try:
                ast.parse(longest[:n])
                fine = True
            except SyntaxError:
                fine = False
            assert (X.failure(longest[:n], lang) is None) == fine, longest[:n]
    elif lang == "json":
        for n in range(len(longest)):
            try:
                json.loads(longest[:n])
                fine = True
            except ValueError:
                fine = False
            assert (X.failure(longest[:n], lang) is None) == fine
    else:
        f = X.failure(longest[: longest.rindex("}")], lang)
        assert f is not None and f.code == "unexpected_end"


def test_place_and_kind():
    assert X.failure("a = 1\nb = = 2\n", "python")[:] == ("unexpected_token", 2, "=")
    assert X.failure('{"a": 1,\n "b" 2}', "json")[:] == ("unexpected_token", 2, "2")
    assert X.failure("x = 1;\n<<<<<<< HEAD\ny\n=======\nz\n>>>>>>> b\n", "javascript").code == "merge_conflict"
    assert X.failure("package a\n\nfunc f() {\n\tx(\n", "go").code == "unexpected_end"
    assert X.failure("x = $\n", "python").code == "bad_token"
    assert X.failure(None, "go") is None and X.failure("{", "cobol") is None and X.failure("{", None) is None


def test_ambiguity_stays_small():
    g = X.language("python").grammar
    before = len(g._nodes)
    assert X.failure("x = " + "[(" * 40 + "1" + ",)]" * 40 + "\n", "python") is None
    assert len(g._nodes) - before < 60_000
    assert X.failure("[" * 3000 + "]" * 3000, "json") is None


def test_small_grammar():
    g = Grammar("s = 'a' s 'b' | ;", "s")
    a, b = g.tokens["a"], g.tokens["b"]
    assert g.read([]) == -1 and g.read([a, a, b, b]) == -1
    assert g.read([a, a, b]) == 3 and g.read([a, b, b]) == 2 and g.read([b]) == 0


def test_operator(spark):
    rows = [(1, "x = (", "python", "r1"), (2, "x = 1", "python", "r1"), (3, None, "json", "r1"), (4, "{", "json", "r2"), (5, "{", "yaml", "r2"), (6, "{", None, "r2"), (7, "[" + "1," * 200_000 + "1]", "json", "r2"), (8, "", "go", "r2")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, language string, repository_id string").selectExpr("*", "'x' as code", "1 as files")
    bad = X.invalid(df)
    assert {(r.doc_id, r.language, r.code) for r in bad.collect()} == {(1, "python", "unexpected_end"), (4, "json", "unexpected_end"), (8, "go", "unexpected_end")}
    got = {(r.repository_id, r.language): (r.files, r.invalid, r.rate) for r in X.rates(df, bad).collect()}
    assert got == {("r1", "python"): (2, 1, 0.5), ("r1", "json"): (1, 0, 0.0), ("r2", "json"): (2, 1, 0.5), ("r2", "go"): (1, 1, 1.0)}
    assert X.invalid(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "lang,text,valid",
    [
        ("javascript", "let a = <div>hi</div>;\n", True),
        ("javascript", "export default function A({x}) {\n  return (\n    <ul className='b' {...x} on={() => go(x)}>\n      {x.map(i => <li key={i}>don't {i} &amp; go</li>)}\n      {/* none */}\n      <A.B c=\"d\" e />\n    </ul>\n  );\n}\n", True),
        ("javascript", "const a = <><b/>text</>;\n", True),
        ("typescript", "const a: X = <B<string> c={d as E} />;\n", True),
        ("javascript", "let a = <div>hi</span>;\n", False),
        ("javascript", "let a = <div>hi", False),
        ("javascript", "let a = <div>{b c}</div>;\n", False),
        ("javascript", "let a = <div b={}", False),
        ("javascript", "if (a < b) { c = '</d>'; }\n", True),
        ("typescript", "interface A {\n  b: string\n  [key: string]: unknown\n}\n", True),
        ("typescript", "type A = {\n  b?: number[]\n  [k: string]: any\n  c: X\n}\n", True),
        ("typescript", "const a = b\n[0]\n", True),
        ("typescript", "const a = b\n[0\n", False),
    ],
)
def test_markup_and_index_signatures(lang, text, valid):
    assert (X.failure(text, lang) is None) is valid


@pytest.mark.parametrize("lang,opens,closes", [("python", "x = (", ")"), ("json", "[", "]"), ("javascript", "x = [", "]")])
def test_deep_nesting(lang, opens, closes):
    head, mark = opens[:-1], opens[-1]
    fine = head + mark * 30_000 + ("" if lang == "json" else "1") + closes * 30_000 + "\n"
    assert X.language(lang).failure(fine) is None
    assert X.failure(fine[:-3], lang).code == "unexpected_end"
