"""Declarations by blocks against hand-counted rows, and extractors of one's own."""

import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codestrata.data.samples import DECLARED, SAMPLES, chapters
from codestrata.functions.text import LANGUAGES
from codestrata.operators import blocks, graph as G, symbols as SY
from codestrata.operators.extractors import Extractors, checked, per_text


def told(text, language):
    return [(d["kind"], d["name"], d["owner"], d["line"], d["end_line"]) for d in blocks.scan(text, language)]


@pytest.mark.parametrize("ext", list(LANGUAGES))
def test_samples_give_the_hand_counted_rows(ext):
    want = sorted((tuple(d[1:]) for d in DECLARED if d[0] == ext), key=str)
    assert sorted(told(SAMPLES[ext], LANGUAGES[ext]), key=str) == want
    assert sorted(told(SAMPLES[ext].replace("\n", "\r\n"), LANGUAGES[ext]), key=str) == want


def test_heads_over_lines_keep_their_parts():
    got = {d["name"]: d for d in blocks.scan(SAMPLES["cs"], "csharp")}
    assert got["LoadAsync"]["params"] == "string path, int retries = 3" and got["LoadAsync"]["rtype"] == "Task<IReadOnlyDictionary<string, int>>"
    assert got["LoadAsync"]["mods"] == "public async" and got["Hidden"]["mods"] == "" and got["Range"]["rtype"] == "(int low, int high)"
    assert got["Outer"]["bases"] == "Base<T>, IDisposable" and got["Deep"]["owner"] == "Outer.Inner"
    java = {d["name"]: d for d in blocks.scan(SAMPLES["java"], "java")}
    assert java["rows"]["rtype"] == "List<Map<String, Integer>>" and java["Pair"]["bases"] == "Comparable<Pair<A, B>>" and java["same"]["rtype"] == "T"
    go = {d["name"]: d for d in blocks.scan(SAMPLES["go"], "go")}
    assert go["Area"]["params"] == "scale float64," and go["Area"]["rtype"] == "(float64, error)"
    py = {d["name"]: d for d in blocks.scan(SAMPLES["py"], "python")}
    assert py["first"]["rtype"] == "int" and py["after"]["mods"] == "async" and py["Outer"]["bases"] == "Base, metaclass=Meta"


def test_owner_returns_after_a_nested_class():
    text = "class A {\n class B { void x() { } }\n void y() { }\n}\nclass C { void z() { } }"
    assert told(text, "java") == [("class", "A", None, 1, 4), ("class", "B", "A", 2, 2), ("method", "x", "A.B", 2, 2), ("method", "y", "A", 3, 3), ("class", "C", None, 5, 5), ("method", "z", "C", 5, 5)]


def test_what_is_no_declaration():
    assert told("class A { int x = f(1); Func<int> g = () => { return 2; }; event E Changed; delegate void D(int a); }", "csharp") == [("class", "A", None, 1, 1)]
    assert told("function f() { if (a) { b() } while (c) { } switch (d) { } for (;;) { } }", "javascript") == [("method", "f", None, 1, 1)]
    assert told("x = 'class A:'\n# def f():\nif x:\n    class_name = 1\ndefault = 2", "python") == []
    assert told("}}} ) ; class A {", "java") == [("class", "A", None, 1, 1)]
    assert told("", "java") == told("class A {}", "cobol") == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["class A ", "{", "}", "(", ")", ";", "void f", "\n", "\n    ", "'", '"', "`", "/*", "*/", "//", "def g", ":", "func h", "type T struct", "=>", "=", "[", "]", "é", "\\", "#", '"""', "@x"]), max_size=40),
       st.sampled_from(sorted(blocks.HIDDEN)))
def test_any_text_is_read(parts, language):
    text = "".join(parts)
    lines = text.count("\n") + 1
    for d in blocks.scan(text, language):
        assert 1 <= d["line"] <= d["end_line"] <= lines and d["name"]


@pytest.mark.parametrize("text", ["class A { " + "word " * 40_000 + "(", "{" * 50_000, "class A { void f() { " * 3000, "a(b) " * 40_000 + "{", '"' * 30_000, "/*" * 30_000, "x = (" * 20_000, "def f(" * 20_000])
def test_long_texts_take_time_in_proportion(text):
    begin = time.time()
    for language in blocks.HIDDEN:
        blocks.scan(text, language)
    assert time.time() - begin < 20


FILES = [("a.cs", "public class A { public int X { get; set; } class In { int F() { return 1; } } int F() { return 2; } }"), ("n.txt", "Head one\npart a\npart b\nTail\npart c"), ("b.py", "class P:\n    def q(self): pass"),
         ("empty.cs", ""), ("none.cs", None), ("u.zzz", "class Z { }")]


def test_own_languages_join_the_others(spark):
    languages = Extractors().add("chapters", per_text(chapters), ["txt"])
    files = languages.with_language(spark.createDataFrame(FILES, "file_name string, content string").withColumn("kind", F.lit(1)))
    symbols = languages.symbols(files)
    assert symbols.columns == [f.split()[0] for f in blocks.SYMBOLS.split(", ")]
    counts = {r.file_name: (r.language, r.classes, r.methods, r.properties) for r in SY.file_counts(files, symbols=symbols).collect()}
    assert counts == {"a.cs": ("csharp", 2, 2, 1), "n.txt": ("chapters", 2, 3, 0), "b.py": ("python", 1, 1, 0), "empty.cs": ("csharp", 0, 0, 0), "none.cs": ("csharp", 0, 0, 0), "u.zzz": ("unknown", 0, 0, 0)}
    nodes = {r.node_id for r in G.dep_nodes(G.declared(symbols, files)).collect()}
    assert {"a.cs::::A", "a.cs::::A.In", "a.cs::::A.In::F", "a.cs::::A::F", "n.txt::::Head", "n.txt::::Tail::part"} <= nodes and len(nodes) == 11  # two parts of one name in one chapter are one node
    assert languages.symbols(files.limit(0)).count() == 0


def test_an_extractor_may_be_a_table_and_replace_a_language(spark):
    own = Extractors().add("python", lambda f: f.select("file_name", "language", F.lit("class").alias("kind"), F.lit("Only").alias("name"), F.lit(1).alias("line")))
    files = own.with_language(spark.createDataFrame(FILES, "file_name string, content string"))
    got = [(r.name, r.owner, r.end_line, r.bases) for r in own.symbols(files).where("language = 'python'").collect()]
    assert got == [("Only", None, 1, "")]


def test_wrong_extractors_are_told(spark):
    files = spark.createDataFrame([("n.txt", "chapters", "Head")], "file_name string, language string, content string")
    with pytest.raises(ValueError, match="lacks"):
        checked(files.withColumn("kind", F.lit("class")))
    with pytest.raises(ValueError, match="column line"):
        checked(files.select("file_name", "language", F.lit("class").alias("kind"), F.lit("a").alias("name"), F.lit("1").alias("line")))
    with pytest.raises(Exception, match="an extractor gave"):
        per_text(lambda t: [{"kind": "chapter", "name": "x", "line": 1}])(files).collect()


def test_blocks_need_no_shuffle(spark):
    files = spark.createDataFrame(FILES, "file_name string, content string").withColumn("language", F.lit("csharp"))
    assert "Exchange" not in blocks.block_symbols(files)._jdf.queryExecution().executedPlan().toString()
