"""Members, grouped declarations and calls of Go, methods of ECMAScript classes."""

from strataloom.operators.extract import code, manifests

GO = '''package p

import (
	f "fmt"
	_ "x/y" // why
)

type (
	T struct {
		A, B int `json:"a"`
		run func(x int) error
		*pkg.Base
		Inner struct{ Z int }
		list [3]int
	}
	I interface {
		Do(a int) (string, error)
		io.Reader
	}
	G[K comparable, V any] map[K]V
	Arr [N]int
)

const (
	X = iota
	y
)
var a, b = 1, "func no() { gone() }"

func (t *G[K, V]) Run(v interface{},
	w int) map[string]struct{} {
	go func() { t.mu.Lock() }()
	x := []byte(f.Sprint(len(v.(I).Do(1))))
	h[int](x); a[0].call(); (*t).z(1); []pkg.U(x)
	if (w) > 0 { return make(map[string]struct{}) }
	type L interface{ Not(int) }
	return nil // none()
}
'''


def test_go():
    rows = list(code.go_symbols(1, "p.go", GO))
    assert {(r[1], r[3]) for r in rows if r[1]} == {
        ("package", "p"), ("class", "p.T"), ("field", "p.T.A"), ("field", "p.T.B"), ("method", "p.T.run"), ("field", "p.T.*pkg.Base"), ("field", "p.T.Inner"), ("field", "p.T.list"),
        ("interface", "p.I"), ("method", "p.I.Do"), ("method", "p.I.io.Reader"), ("type", "p.G"), ("type", "p.Arr"),
        ("constant", "p.X"), ("constant", "p.y"), ("variable", "p.a"), ("variable", "p.b"), ("method", "p.G.Run"),
    }
    by_name = {r[3]: r for r in rows if r[1]}
    assert by_name["p.T.A"][4:8] == ("A int", "public", 10, 10) and by_name["p.T.run"][4] == "run func(x int) error" and by_name["p.I.Do"][4] == "Do(a int) (string, error)"
    assert by_name["p.G.Run"][4] == "Run(v interface{}, w int) map[string]struct{}" and by_name["p.G.Run"][6:8] == (30, 38)
    assert [r[9] for r in rows if r[8] == "imports"] == ["fmt", "x/y"]
    assert sorted(r[9] for r in rows if r[8] == "calls") == sorted(["t.mu.Lock", "f.Sprint", "len", "Do", "h", "a.call", "z", "make"])
    assert {r[3] for r in rows if r[8] == "calls"} == {"p.G.Run"}


def test_go_broken():
    assert [r[1] for r in code.go_symbols(1, "p.go", "package p\nfunc (")] == ["package"]
    assert [r[3] for r in code.go_symbols(1, "p.go", "package p\n=======\nconst E = 1\n") if r[1]] == ["p", "p.E"]
    assert [r[1] for r in code.go_symbols(1, "p.go", None)] == ["package"]
    assert [r[1] for r in code.go_symbols(1, "p.go", "type T struct {\nA int")] == ["package", "class", "field"]
    assert [r[3] for r in code.go_symbols(1, "p.go", "package p\nfunc a() {\n\tif x {\n\t\tb(\n}\nfunc c() { d() }\nconst E = 1\n") if r[1]] == ["p", "p.a", "p.c", "p.E"]


TS = '''export class A<T extends { a: 1 }> extends B<T> implements C {
  static x = () => { return 1 }
  private y: Map<string, number> = new Map()
  re = /[{"]/g
  @dec({ a: 1 })
  constructor(private q: string) { super(`${q}{`) }
  async *gen<T>(a: T): AsyncIterable<T> { if (a) { call(a) } }
  get size(): number { return 1 }
  get(k: string): { a: number } | null { return null }
  protected abstract later(a: number): void
  #own() {}
  ['computed']() {}
  static { init() }
  'quoted'() {}
}
class D { m() {} }
function g() { class Local { no() {} } }
'''


def test_ecma_methods():
    rows = [r for r in code.ecma_symbols(1, "m.ts", TS) if r[1]]
    got = {(r[1], r[3], r[5]) for r in rows if r[1] in ("method", "constructor")}
    assert got == {
        ("constructor", "m.A.constructor", "public"), ("method", "m.A.gen", "public"), ("method", "m.A.size", "public"), ("method", "m.A.get", "public"), ("method", "m.A.later", "private"),
        ("method", "m.A.#own", "private"), ("method", "m.A.['computed']", "public"), ("method", "m.A.quoted", "public"), ("method", "m.D.m", "public"),
    }
    assert {r[4] for r in rows if r[2] == "get"} == {"get(k: string): { a: number } | null"}
    assert {r[3] for r in rows if r[1] == "class"} == {"m.A", "m.D"}


API = """openapi: 3.0.1
info: {title: A, version: 1.0}
paths:
  /x:
    get:
      operationId: o
      parameters:
        - {name: q, in: query}
      responses:
        200: {$ref: '#/r'}
components:
  schemas:
    S: {}
"""


def test_openapi_yaml():
    rows = lambda text: {(r[1], r[2], r[3], r[4], r[5]) for r in manifests.any_manifest(1, "a/api.yaml", text)}
    assert rows(API) == {("api_service", "A", "1.0", None, None), ("api_endpoint", "GET /x", "o", "exposes", "A"), ("parameter", "q", "query", "contains", "GET /x"), ("return_value", "200", "", "contains", "GET /x"), ("schema", "S", "", "contains", "A"), (None, None, None, "references", "#/r")}
    assert rows(API + "info: {}\n") == set() and rows(API + "x: &a 1\ny: *a\n") == set() and rows("openapi: [") == set() and rows("a: 1\n") == set()
