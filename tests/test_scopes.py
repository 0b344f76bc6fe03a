import time

import pytest

from lumenfold.operators import scopes

CODE = {
    "a.ts": ('''import { x, y } from "m"; // { not a scope
import z from 'z'
export interface Shape { area(): number; }
enum Colour { Red, Green }
@Injectable({ deep: true })
export class Box extends Base {
  private n = { a: "}" };
  constructor(w: number, h = 2) { super(); this.w = w; }
  async grow(by: number): Promise<void> { if (by) { go(`{${by}`); } }
}
export function top(a, b) {
  const re = /[{}]/;
  function inner(c) { return c; }
  return items.map((i) => { return i; });
}
const arrow = (p, q) => { return p; };
''', [("import", "import { x, y } from \"m\";", "", []), ("import", "import z from 'z'", "", []), ("class", "Shape", "", []), ("class", "Colour", "", []), ("class", "Box", "", []),
      ("method", "constructor", "Box", ["w", "h"]), ("method", "grow", "Box", ["by"]), ("function", "top", "", ["a", "b"]), ("function", "inner", "", ["c"]), ("function", "arrow", "", ["p", "q"])]),
    "A.java": ('''import java.util.List;
/* class Not { */
@Entity
public class A<T extends B> implements C {
    @Override
    public int size(final List<String> xs, int n) throws E { for (String s : xs) { use("{"); } return 0; }
    A() { }
    static class In { void run() { Runnable r = new Runnable() { public void run() { } }; } }
}
''', [("import", "import java.util.List;", "", []), ("class", "A", "", []), ("method", "size", "A", ["xs", "n"]), ("method", "A", "A", []), ("class", "In", "A", []), ("method", "run", "In", []), ("method", "run", "In", [])]),
    "b.go": ('''package main
import "fmt"
type Point struct {
    X int
}
func (p *Point) Move(dx, dy int) error {
    s := `}`
    if dx > 0 { fmt.Println("{") }
    return nil
}
func main() { go func() { work() }() }
''', [("import", 'import "fmt"', "", []), ("class", "Point", "", []), ("method", "Move", "Point", ["dx", "dy"]), ("function", "main", "", [])]),
    "c.rs": ('''use std::io::{self, Read};
struct Unit;
pub struct P<'a> { s: &'a str, c: char }
impl<'a> Show for P<'a> {
    fn show(&self, mut n: usize) -> String { let c = '{'; match n { 0 => "}".into(), _ => r#"{"#.into() } }
}
trait T { fn f(&self) -> i32 { 1 } }
fn main() { let x = 1; }
''', [("import", "use std::io::{self, Read};", "", []), ("class", "Unit", "", []), ("class", "P", "", []), ("class", "P", "", []), ("method", "show", "P", ["self", "n"]), ("class", "T", "", []), ("method", "f", "T", ["self"]), ("function", "main", "", [])]),
    "d.cpp": ('''#include <vector>
#define OPEN {
struct S { int a; int get() const { return a; } };
int S::put(int v) { a = v; return '}'; }
static int add(int a, const int *b) { while (a) { a--; } return a; }
enum class E { One, Two };
''', [("import", "#include <vector>", "", []), ("class", "S", "", []), ("method", "get", "S", []), ("method", "put", "S", ["v"]), ("function", "add", "", ["a", "b"]), ("class", "E", "", [])]),
    "e.cs": ('''using System;
namespace N {
    public class K {
        public K(int a) { }
        string Name { get { return @"}"; } }
        void Run(string s, int n = 1) { using (var f = Open()) { } }
    }
    struct V { }
}
''', [("import", "using System;", "", []), ("class", "K", "", []), ("method", "K", "K", ["a"]), ("method", "Run", "K", ["s", "n"]), ("class", "V", "", [])]),
    "f.php": ('''<?php
use A\\B;
# class Not {
class M { public function go($a, int $b = 1) { if ($a) { echo "}"; } } }
function top() { }
''', [("import", "use A\\B;", "", []), ("class", "M", "", []), ("method", "go", "M", ["$a", "$b"]), ("function", "top", "", [])]),
}


@pytest.mark.parametrize("path", sorted(CODE))
def test_nested_scopes(path):
    text, wanted = CODE[path]
    got = scopes.definitions(path, text)
    assert sorted((r[1], r[0], r[8], r[9]) for r in got) == sorted(wanted)
    rows = text.split("\n")
    for r in got:
        span = rows[r[3] - 1 : r[4]]
        span[-1] = span[-1][: r[6]]
        span[0] = span[0][r[5] :]
        assert "\n".join(span) == r[7]
        assert r[1] == "import" or r[7].endswith(("}", ";"))


def test_decorators_unclosed_and_odd_texts():
    got = {r[0]: r[10] for r in scopes.definitions("a.ts", CODE["a.ts"][0])}
    assert got["Box"] == ["@Injectable({ deep: true })"]
    assert scopes.definitions("A.java", CODE["A.java"][0])[1][10] == ["@Entity"]
    assert [(r[0], r[4]) for r in scopes.definitions("x.go", "func f() {\n  if a {\n")] == [("f", 2)]
    for path in CODE:
        for text in ("", "}", "{", "'", '"', "/*", "(((", "}}}{{{", "import", "class", "\n\n", "@", "@("):
            scopes.definitions(path, text)


def test_calls_and_complexity_pass_over_strings():
    body = 'function f(a) { if (a && b) { go("if (x) call()"); } // while (x)\n return a ? one() : two(); }'
    assert scopes.calls(body, "js") == ["go", "one", "two"] and scopes.complexity(body, "js") == 4


def test_large_literals_and_deep_braces_take_linear_time():
    began = time.perf_counter()
    for path, text in (("a.js", "x = [" + "{a:1}," * 20000 + "]"), ("a.js", "x = {" + "k: {a: 1},\n" * 20000 + "}"), ("a.c", "{" * 40000), ("a.go", "type T struct { a int }\n" * 5000)):
        scopes.definitions(path, text)
    assert time.perf_counter() - began < 20
