import random

from pyspark.sql import functions as F

from codestrata.data.rules import Rule, SECURITY
from codestrata.operators import graph as G, legacy as L, measures as M, rulescan as RS, smells as SM, symbols as SY
from codestrata.operators import rollup as U
from codestrata.functions.text import detect_language
from conftest import rows

CORPUS = {
    "a/Shop.cs": "using System;\r\nusing Shop.Data;\r\nnamespace Shop.Core\r\n{\r\npublic class Cart : Base, ICart\r\n{\r\n    public int Total { get; set; }\r\n"
                 "    public static int Sum(string a, int b, bool c)\r\n    {\r\n        if (b > 1 && c) { return Helper(b); }\r\n        return 0;\r\n    }\r\n"
                 "    private void Lost(int x)\r\n    {\r\n        // TODO later\r\n    }\r\n}\r\n}",
    "a/helper.cs": "namespace Shop.Util\n{\npublic class Tools\n{\n    public int Helper(int n) { return n; }\n}\npublic class Base { }\n}",
    "b/work.py": "import os\nfrom a.b import c\nclass Job(Base):\n    async def run(self, x):\n        if x: return eval(x)\n        for i in x:\n            pass\n",
    "b/page.js": "import x from 'lib';\nclass View extends Page {\n  draw(a) {\n    var t = a;\n  }\n}\nfunction go(a, b) {\n  return 1;\n}\n",
    "b/type.ts": "const q = require('db');\nexport async function load(a: string): Promise<number> {\n  if (a) { return 2; }\n}\n",
    "c/Main.java": "package shop.app;\nimport java.util.*;\npublic class Main extends Base implements Run {\n    private static int go(int a) { return a; }\n}\n",
    "c/main.go": "package main\nimport \"fmt\"\ntype Node struct {\n}\nfunc (n *Node) Walk(a int) int {\n\treturn 1\n}\nfunc top() {\n}\n",
    "c/empty.py": "",
}


def corpus(spark, extra=None):
    data = dict(CORPUS, **(extra or {}))
    df = spark.createDataFrame(list(data.items()), "file_name string, content string")
    return df.withColumn("language", detect_language(F.col("file_name")))


def test_symbols_by_hand_count(spark):
    f = corpus(spark)
    c = {r.file_name: (r.classes, r.methods, r.properties, r.imports) for r in SY.file_counts(f).collect()}
    assert c == {"a/Shop.cs": (1, 2, 1, 2), "a/helper.cs": (2, 1, 0, 0), "b/work.py": (1, 1, 0, 2), "b/page.js": (1, 2, 0, 1), "b/type.ts": (0, 1, 0, 1),
                 "c/Main.java": (1, 1, 0, 1), "c/main.go": (1, 2, 0, 1), "c/empty.py": (0, 0, 0, 0)}
    cls = {(r.file_name, r["name"], r.line, r.bases) for r in SY.extract_symbols(f, "class").collect()}
    assert ("a/Shop.cs", "Cart", 5, "Base, ICart") in cls and ("b/work.py", "Job", 3, "Base") in cls and ("c/Main.java", "Main", 3, "Base, Run") in cls
    fn = {(r["name"], r.owner, r.is_static, r.is_async, r.access) for r in SY.extract_symbols(f, "method").collect()}
    assert {("Sum", "Cart", True, False, "public"), ("run", "Job", False, True, ""), ("Walk", "Node", False, False, ""), ("go", "Main", True, False, "private")} <= fn
    sig = {r.signature for r in SY.signatures(SY.extract_symbols(f)).collect()}
    assert "public class Cart : Base, ICart" in sig and "public static int Cart.Sum(string a, int b, bool c)" in sig and "public int Cart.Total { get; set; }" in sig
    imp = {(r.file_name, r.module, r.is_wildcard) for r in SY.extract_imports(f).collect()}
    assert ("c/Main.java", "java.util", True) in imp and ("b/type.ts", "db", False) in imp and ("b/work.py", "a.b", False) in imp
    assert dict((r.file_name, r.container) for r in SY.extract_container(f).collect())["c/Main.java"] == "shop.app"


def test_measures(spark):
    f = corpus(spark)
    cyc = {r.file_name: (r.cyclomatic, r.loc) for r in M.cyclomatic(f).collect()}
    # two C# methods; "if" counts once, "&&" stands between blanks and does not
    assert cyc["a/Shop.cs"] == (3, 18) and cyc["b/work.py"][0] == 3 and cyc["c/empty.py"] == (1, 1)
    long = corpus(spark, {"l.py": "def f():\n" + "    x\n" * 55 + "def g():\n    y"})
    got = {(r.line, r.length, r.is_long) for r in M.function_length(long).where("file_name = 'l.py'").collect()}
    assert got == {(1, 56, True), (57, 2, False)}
    score = spark.range(1).select(M.file_complexity(F.lit(20), F.lit(0), F.lit(0)), M.report_complexity(F.lit(1), F.lit(2), F.lit(1)), M.page_complexity(F.lit(1), F.lit(2), F.lit(1))).first()
    assert tuple(score) == (100, 3, 3)


def test_rule_scan_and_registry(spark):
    f = corpus(spark)
    assert ("b/work.py", "py-eval") in rows(RS.rule_scan(f, SECURITY), "file_name", "rule_id")
    counts = {r.file_name: r.security_hits for r in RS.hit_counts(f).collect()}
    assert counts["b/work.py"] >= 1 and counts["c/empty.py"] == 0
    table = RS.rules_table(spark, SECURITY)
    a = rows(RS.rule_scan(f, SECURITY), "file_name", "rule_id")
    assert rows(RS.rule_scan_table(f, table), "file_name", "rule_id") == a
    new = RS.rules_table(spark, [Rule("only", ("python",), "security", "Low", (r"pass",))])
    got = rows(RS.rule_scan_table(f, RS.register_rules(table, new)), "file_name", "rule_id")
    assert ("b/work.py", "only") in got and not any(r == "py-eval" for _, r in got)


def test_located_matches_cross_lines(spark):
    text = "a\nDataSet\n\n x DataSet y\ncatch (E e)\n{\n}\nh = 3600;\n7 = 7\nk: 24 : 'x'"
    f = corpus(spark, {"z.py": text}).where("file_name = 'z.py'")
    assert rows(L.obsolete_api(f), "line", "snippet") == [(2, "DataSet\n\n "), (4, "DataSet ")]
    assert rows(L.empty_catch(f), "line") == [(5,)]
    assert rows(L.magic_numbers(f), "line", "snippet") == [(8, "3600"), (9, "7")]


def test_legacy_and_smells(spark):
    god = "public class Big\n{\n" + "\n".join(f"    public int M{i}(int a) {{ return a; }}" for i in range(20)) + "\n}"
    deep = "\n".join(["public class A { }", "public class B : A { }", "public class C : B { }", "public class D : C { }", "public class E : D { }", "public class F1 : Out { }"])
    f = corpus(spark, {"g.cs": god, "d.cs": deep})
    assert rows(L.god_objects(f), "class_name", "methods") == [("Big", 20)]
    assert ("Lost", "never called") in rows(L.dead_methods(f), "method", "reason") and ("Lost", "work marker") in rows(L.dead_methods(f), "method", "reason")
    assert rows(SM.inheritance_depth(f), "class_name", "depth") == [("E", 5)]
    assert rows(SM.inheritance_depth(f, 1).where("class_name = 'F1'"), "depth") == [(2,)]
    assert ("a/Shop.cs", "Sum", 3) in rows(SM.primitive_params(f), "file_name", "method", "n_primitive")
    assert ("a/Shop.cs",) in rows(SM.static_cling(f), "file_name")
    q = SM.semantic_quality(spark.createDataFrame([("a", 3), ("b", 30)], "file_name string, severity int"), spark.createDataFrame([("a", True), ("a", False)], "file_name string, is_deprecated boolean"))
    assert rows(q) == [("a", 75), ("b", 0)]


def test_graph_edges(spark):
    f = corpus(spark, {"lib/shared/tool.py": "class Tool:\n    def x(self):\n        pass\n", "p/user.py": "import lib.shared.tool\nimport user\nclass U:\n    pass\n"})
    nodes, edges = G.dependency_graph(f)
    got = {(r.source_file, r.target_file, r.type) for r in edges.collect()}
    assert ("a/Shop.cs", "a/helper.cs", "MethodCall") in got and ("a/Shop.cs", "a/helper.cs", "Inheritance") in got
    assert ("p/user.py", "lib/shared/tool.py", "TypeReference") in got
    assert not any(s == t for s, t, _ in got)
    imp = {r.node_id: (r.affected_files, r.risk) for r in G.impact(nodes, edges).collect()}
    assert imp["a/helper.cs::Shop.Util::Tools::Helper"] == (1, "Low")


def test_cycles_and_members(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "x"), ("e", "f"), ("z", "a")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    assert rows(G.cycles(e)) == [("a", 2, "a -> b -> a", 2, 3), ("c", 3, "c -> d -> e -> c", 3, 4)]
    assert rows(G.cycle_members(e)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")]
    assert rows(G.short_cycles(e, max_len=2), "cycle") == [("a -> b -> a",)]


def test_graph_loops_do_not_broadcast(spark):
    """Some hundred joins run in the loops: a broadcast in each would add up on the driver."""
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("c", "e")], "src string, dst string")
    for out in (G._trim_once(e), G.cycle_members(e), G.cycles(e), G.short_cycles(e, 3)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_long_ring_is_one_cycle(spark):
    ring = [f"n{i:02d}" for i in range(20)]
    e = spark.createDataFrame([*zip(ring, ring[1:] + ring[:1]), ("n00", "out"), ("in", "n03")], "src string, dst string")
    assert rows(G.cycles(e)) == [("n00", 20, " -> ".join([*ring, "n00"]), 20, 5)]
    assert rows(G.cycles(e.limit(0))) == []


def test_modules_and_batches(spark):
    df = spark.createDataFrame([("x/Services/a.cs", ""), ("x/odd/a.cs", ""), ("a.cs", ""), ("x/Services/b.cs", "Shop.Core")], "f string, c string")
    assert [r[0] for r in df.select(U.module_of(F.col("f"), F.col("c"))).collect()] == ["Services", "odd", "Other", "Core"]
    data = [(f"f{i:03d}", "big" if i % 3 else f"m{i % 2}") for i in range(57)]
    packed = U.pack_batches(spark.createDataFrame(data, "file_name string, module string"), 10).collect()
    assert sorted(r.position for r in packed) == list(range(57))
    sizes = {m: sum(1 for _, x in data if x == m) for m in {"big", "m0", "m1"}}
    order = sorted(data, key=lambda x: (-sizes[x[1]], x[1], x[0]))
    assert {r.file_name: r.position for r in packed} == {f: i for i, (f, _) in enumerate(order)}


def test_peer_pairs_and_contradictions(spark):
    a = spark.createDataFrame([(1, "S"), (1, "S"), (1, "P"), (2, "P")], "project int, agent string")
    assert rows(G.peer_pairs(a), "project", "reviewer", "reviewee", "n_reviews") == [(1, "P", "S", 2), (1, "S", "P", 2), (1, "S", "S", 2)]
    f = spark.createDataFrame([(1, "x", "CRITICAL", "A:1", ["e"]), (2, "x", "low", "A:1", ["q"]), (3, "x", "CRITICAL", "", None), (4, "x", "LOW", "", ["e"]),
                               (5, "Security", "HIGH", "B", ["K"]), (6, "Safe", "HIGH", "C", ["k", "k"]), (7, "other", "HIGH", "C", ["k"])],
                              "finding_id int, category string, severity string, location string, evidence array<string>")
    assert rows(G.contradictions(f), "key", "n_pairs") == [("A:1", 1), ("k", 1)]
    assert rows(G.contradicted(f)) == [(1,), (2,), (5,), (6,)]


def reach(edges):
    out = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for x, y in edges:
                if x == todo[-1] and y not in seen:
                    seen.add(y)
                    todo.insert(0, y)
            todo.pop()
        out[a] = seen
    return out


def many_graphs(rng):
    """Small graphs side by side: rings, chains into and out of rings, chains between nodes of one component and of two, folded loops, repeated edges."""
    out = []
    for g in range(70):
        n = rng.randint(2, 9)
        for _ in range(rng.randint(1, 2 * n)):
            out.append((g, rng.randrange(n), rng.randrange(n)))
        a, b, k = rng.randrange(n), rng.randrange(n), rng.randint(1, 6)
        way = [a, *range(100, 100 + k), b]
        out += [(g, x, y) for x, y in zip(way, way[1:])]
    return [(f"g{g:02}n{x:03}", f"g{g:02}n{y:03}") for g, x, y in out]


def test_cycles_of_many_graphs_equal_brute_force(spark):
    edges = many_graphs(random.Random(41))
    far = {}
    for g in {a[:3] for a, _ in edges}:
        far |= reach([e for e in edges if e[0][:3] == g and e[0] != e[1]])
    want = {a: min(b for b in far[a] if a in far[b]) for a in far if a in far[a]}
    e = spark.createDataFrame(edges, "src string, dst string").repartition(3)
    assert dict(rows(G.cycle_members(e))) == want
    steps = {}
    for a, b in edges:
        steps.setdefault(a, set()).add(b)
    for r in G.cycles(e).collect():
        way = r.cycle.split(" -> ")
        assert way[0] == way[-1] == r.component and len(set(way)) == len(way) - 1 == r.n_nodes
        assert all(b in steps[a] for a, b in zip(way, way[1:])) and r.n_members == sum(c == r.component for c in want.values())
        level, n = {r.component}, 0  # the least number of steps that lead back
        while True:
            level, n = {y for x in level for y in steps.get(x, ()) if x != y}, n + 1
            if r.component in level:
                break
        assert n == r.n_nodes


def test_a_ring_of_many_nodes_takes_few_rounds(spark, monkeypatch):
    """Rounds grow with the logarithm: a ring of 30,000 nodes with a tail of 10,000 on either side."""
    n, wrote, real = 30_000, [], G.written
    monkeypatch.setattr(G, "written", lambda df: wrote.append(1) or real(df))
    ring = spark.range(n).selectExpr("format_string('r%06d', id) AS src", f"format_string('r%06d', (id + 1) % {n}) AS dst")
    tails = spark.range(10_000).selectExpr("format_string('a%06d', id) AS src", "CASE WHEN id = 9999 THEN 'r000007' ELSE format_string('a%06d', id + 1) END AS dst").unionByName(
        spark.range(10_000).selectExpr("CASE WHEN id = 0 THEN 'r000011' ELSE format_string('z%06d', id) END AS src", "format_string('z%06d', id + 1) AS dst"))
    got = G.cycle_members(ring.unionByName(tails))
    assert got.count() == n and got.select("component").distinct().collect()[0][0] == "r000000"
    assert len(wrote) < 60
