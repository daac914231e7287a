"""Code texts with nested types, heads over several lines and members without modifiers, and what they declare.

``DECLARED`` was counted by hand, line by line: (sample, kind, name, owner, line, end line).
"""

from __future__ import annotations

import re

SAMPLES = {
    "cs": '''using System;
namespace Shop.Nested;
/* class Ghost { void Boo() { } } */
public record Point(int X, int Y);
public abstract class Outer<T>
    : Base<T>, IDisposable
    where T : class
{
    string text = "class Fake { ";
    int Hidden(int a)
    {
        Func<int, int> f = x => { return x + 1; };
        int Local(int z) { return z; }
        return f(a);
    }
    [Obsolete("void Old() {")]
    public async Task<IReadOnlyDictionary<string, int>> LoadAsync(
        string path,
        int retries = 3)
    {
        if (retries > 0) { await Go(path); }
        return null;
    }
    private sealed class Inner
    {
        public Inner(int n) : base(n) { }
        internal struct Deep { public int Sum() => 1 + 2; }
        void After() { }
    }
    public int Count { get; set; } = 5;
    public abstract void Render(int depth);
    public (int low, int high) Range(int n) { return (n, n); }
}
interface IShape
{
    double Area();
    string Name { get; }
}
enum Colour { Red, Green }
''',
    "py": '''"""class Doc: def ghost(): pass"""
import os
class Outer(Base,
            metaclass=Meta):
    text = "def fake(): pass"
    def first(
        self,
        a,
        b=(1, 2),
    ) -> int:
        def helper(x):
            return x
        return helper(a)

    class Inner:
        def deep(self): return 1

    async def after(self):
        # def commented(): pass
        return None
def top():
    return [
        1,
    ]
''',
    "js": '''// class Ghost {}
import { a } from './a'
export default class Cart extends Base {
  items = []
  constructor(owner) { super(owner) }
  add(
    item,
    count = pick(1),
  ) {
    const note = `class Fake { ${item}`
    if (item) { this.items.push(item) }
    return /[{"]/.test(note)
  }
  static async load(id) {
    return fetch(id).then(function named(r) { return r })
  }
}
const total = (rows) => {
  return rows.length
}
function outer(x) {
  function inner(y) { return y }
  return inner(x)
}
''',
    "ts": '''export interface Shape {
  area(): number;
}
export abstract class Box<T> implements Shape, Named {
  private readonly side: number = 2;
  constructor(private name: string) { }
  public area(): number { return this.side * this.side; }
  protected map<U>(
    f: (x: T) => U,
  ): U[] {
    return [];
  }
}
enum Kind { A, B }
export async function build(
  kind: Kind,
): Promise<Box<number>> {
  return new Box('{');
}
''',
    "java": '''package shop.nested;
/** class Ghost { } */
public record Pair<A, B>(A left, B right) implements Comparable<Pair<A, B>> {
    static <T> T same(T x) { return x; }
}
class Outer extends Base implements Runnable, Closeable {
    private String s = "{ class Fake";
    Outer(int n) { super(n); }
    @Override
    public void run() { Runnable r = new Runnable() { public void run() { } }; }
    List<Map<String, Integer>> rows(
            String name,
            int limit)
            throws IOException {
        for (int i = 0; i < limit; i++) { go(i); }
        return null;
    }
    static class Inner {
        int size() { return 1; }
    }
    void after() { }
}
enum Colour { RED(1), BLUE(2); Colour(int n) { } int code() { return 1; } }
interface Shape { double area(); default String name() { return "}"; } }
''',
    "go": '''package nested

// type Ghost struct {}
type Box struct {
\tside int
\tinner struct{ x int }
}

type (
\tShape interface {
\t\tArea() float64
\t}
)

func (b *Box) Area(
\tscale float64,
) (float64, error) {
\tf := func(x float64) float64 { return x }
\treturn f(scale), nil
}

func Build(names ...string) *Box {
\treturn &Box{side: len("func Fake() {")}
}
''',
    "txt": "class Note { }\n",
}

#: Fixed: counted by hand.
DECLARED = [
    ("cs", "record", "Point", None, 4, 4), ("cs", "class", "Outer", None, 5, 33), ("cs", "method", "Hidden", "Outer", 10, 15), ("cs", "method", "LoadAsync", "Outer", 17, 23),
    ("cs", "class", "Inner", "Outer", 24, 29), ("cs", "constructor", "Inner", "Outer.Inner", 26, 26), ("cs", "struct", "Deep", "Outer.Inner", 27, 27),
    ("cs", "method", "Sum", "Outer.Inner.Deep", 27, 27), ("cs", "method", "After", "Outer.Inner", 28, 28), ("cs", "property", "Count", "Outer", 30, 30),
    ("cs", "method", "Render", "Outer", 31, 31), ("cs", "method", "Range", "Outer", 32, 32), ("cs", "interface", "IShape", None, 34, 38), ("cs", "method", "Area", "IShape", 36, 36),
    ("cs", "property", "Name", "IShape", 37, 37), ("cs", "enum", "Colour", None, 39, 39),
    ("py", "class", "Outer", None, 3, 20), ("py", "method", "first", "Outer", 6, 13), ("py", "method", "helper", "Outer", 11, 12), ("py", "class", "Inner", "Outer", 15, 16),
    ("py", "method", "deep", "Outer.Inner", 16, 16), ("py", "method", "after", "Outer", 18, 20), ("py", "method", "top", None, 21, 24),
    ("js", "class", "Cart", None, 3, 17), ("js", "constructor", "constructor", "Cart", 5, 5), ("js", "method", "add", "Cart", 6, 13), ("js", "method", "load", "Cart", 14, 16),
    ("js", "method", "total", None, 18, 20), ("js", "method", "outer", None, 21, 24), ("js", "method", "inner", None, 22, 22),
    ("ts", "interface", "Shape", None, 1, 3), ("ts", "class", "Box", None, 4, 13), ("ts", "constructor", "constructor", "Box", 6, 6), ("ts", "method", "area", "Box", 7, 7),
    ("ts", "method", "map", "Box", 8, 12), ("ts", "enum", "Kind", None, 14, 14), ("ts", "method", "build", None, 15, 19),
    ("java", "record", "Pair", None, 3, 5), ("java", "method", "same", "Pair", 4, 4), ("java", "class", "Outer", None, 6, 22), ("java", "constructor", "Outer", "Outer", 8, 8),
    ("java", "method", "run", "Outer", 10, 10), ("java", "method", "rows", "Outer", 11, 17), ("java", "class", "Inner", "Outer", 18, 20), ("java", "method", "size", "Outer.Inner", 19, 19),
    ("java", "method", "after", "Outer", 21, 21), ("java", "enum", "Colour", None, 23, 23), ("java", "constructor", "Colour", "Colour", 23, 23), ("java", "method", "code", "Colour", 23, 23),
    ("java", "interface", "Shape", None, 24, 24), ("java", "method", "area", "Shape", 24, 24), ("java", "method", "name", "Shape", 24, 24),
    ("go", "struct", "Box", None, 4, 7), ("go", "interface", "Shape", None, 10, 12), ("go", "method", "Area", "Box", 15, 20), ("go", "method", "Build", None, 22, 24),
]


def chapters(text: str):
    """A language of the user's own: a line that begins with a capital opens a chapter, one with a small letter is a part of it."""
    owner = None
    for i, line in enumerate(text.split("\n")):
        if m := re.match("[A-Z][a-z]+", line):
            owner = m.group()
            yield {"kind": "class", "name": owner, "line": i + 1}
        elif m := re.match("[a-z]+", line):
            yield {"kind": "method", "name": m.group(), "line": i + 1, "owner": owner}
