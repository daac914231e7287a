"""Dependency graph over a corpus: nodes, edges, impact, cycles.

Names resolve to one target (shortest, then first, file name), so an edge table has at
most one row per reference and no name can multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.substr import containing_pairs
from ..functions.text import file_stem, jre
from ..session import cut_lineage, written
from .symbols import CLASS_KINDS, body_of, container_of, extract_imports, owner_of, with_marks

GOD_DEGREE = 20


def declarations(files: DataFrame) -> DataFrame:
    """Class members of every file with namespace, bases and called names, in one pass.

    This slim table carries all the graph needs, so the text is read once.
    """
    base = with_marks(files, ["content"]).withColumn("namespace", container_of())
    base = base.withColumn("classes", F.filter("marks", lambda m: m["kind"] == "class"))

    def full(m: Column, i: Column) -> Column:
        owner = F.when(m["kind"] == "class", m["name"]).otherwise(owner_of(m))
        # what follows the parameter list's opening bracket can hold calls
        inner = F.regexp_replace(body_of(m, i), jre(r"^[^(]*\(", ""), "")
        callees = F.when((F.col("language") == "csharp") & (m["kind"] == "method"),
                         F.regexp_extract_all(inner, F.lit(jre(r"(\w+)\s*\(", "")), F.lit(1)))
        return F.struct(m["line"].alias("line"), m["kind"].alias("kind"), m["name"].alias("name"), owner.alias("owner"),
                        m["bases"].alias("bases"), callees.alias("callees"))

    out = base.select("file_name", "language", "namespace", F.inline(F.transform("marks", full)))
    out = out.where(F.col("kind").isin("class", "method", "property") & F.col("owner").isNotNull())
    return out.withColumn("node_id", F.concat_ws("::", "file_name", "namespace", "owner",
                                                 F.when(F.col("kind") != "class", F.col("name"))))


def declared(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The members that ``dep_nodes`` reads, from a table of symbols (by blocks, or by extractors of one's own).

    A nested type's path names the types around it, so two inner types of one name stay two nodes.
    """
    spaces = files.select("file_name", container_of().alias("namespace"))
    is_type = F.col("kind").isin(CLASS_KINDS)
    path = F.when(is_type, F.concat_ws(".", "owner", "name")).otherwise(F.col("owner"))
    d = symbols.where(is_type | F.col("kind").isin("method", "property")).withColumn("path", path).where("path IS NOT NULL")
    d = d.join(spaces, "file_name").select("file_name", "language", "namespace", "line", F.when(is_type, "class").otherwise(F.col("kind")).alias("kind"),
                                           "name", F.col("path").alias("owner"), "bases")
    return d.withColumn("node_id", F.concat_ws("::", "file_name", "namespace", "owner", F.when(F.col("kind") != "class", F.col("name"))))


def dep_nodes(decl: DataFrame) -> DataFrame:
    """One node per class, method and property; the first declaration of an id wins."""
    full_name = F.when(F.col("kind") == "class",
                       F.when(F.col("namespace") == "", F.col("name")).otherwise(F.concat_ws(".", "namespace", "name"))
                       ).otherwise(F.concat_ws(".", "namespace", "owner", "name"))
    first = F.min(F.struct("line", "kind", "name", "file_name", "namespace", full_name.alias("full_name"))).alias("n")
    return decl.groupBy("node_id").agg(first).select("node_id", "n.*")


def calls(decl: DataFrame) -> DataFrame:
    """Call sites inside C# methods: (file, calling node, called name, how often)."""
    return decl.select("file_name", "node_id", F.explode("callees").alias("callee")).groupBy("file_name", "node_id", "callee").agg(
        F.count("*").alias("n_calls"))


def _first_by_name(nodes: DataFrame, kind: str) -> DataFrame:
    best = F.min(F.struct(F.length("file_name").alias("_l"), F.col("file_name").alias("target_file"), F.col("node_id").alias("target_id")))
    return nodes.where(F.col("kind") == kind).groupBy("name").agg(best.alias("b")).select("name", "b.target_file", "b.target_id")


def _resolve(refs: DataFrame, ref: str, nodes: DataFrame, kind: str) -> DataFrame:
    """A name declared in the referring file stays local; any other goes to its one target."""
    local = nodes.where(F.col("kind") == kind).select("file_name", F.col("name").alias(ref)).distinct()
    outward = refs.join(local, ["file_name", ref], "left_anti")
    targets = _first_by_name(nodes, kind).withColumnRenamed("name", ref)
    return outward.join(targets, ref)


def call_edges(decl: DataFrame, nodes: DataFrame) -> DataFrame:
    return _resolve(calls(decl), "callee", nodes.where(F.col("file_name").endswith(".cs")), "method").select(
        F.col("node_id").alias("source_id"), "target_id", F.col("file_name").alias("source_file"), "target_file",
        F.lit("MethodCall").alias("type"), "n_calls")


def inherit_edges(decl: DataFrame, nodes: DataFrame) -> DataFrame:
    d = decl.where((F.col("language") == "csharp") & (F.col("kind") == "class") & (F.col("bases") != ""))
    base = F.regexp_extract(F.trim("base0"), jre(r"(\w+)(?:<.*)?$", ""), 1)
    refs = d.select("file_name", "node_id", F.explode(F.split("bases", ",")).alias("base0")).select("file_name", "node_id", base.alias("base"))
    return _resolve(refs.distinct(), "base", nodes.where(F.col("file_name").endswith(".cs")), "class").select(
        F.col("node_id").alias("source_id"), "target_id", F.col("file_name").alias("source_file"), "target_file",
        F.lit("Inheritance").alias("type"))


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Module to file: path contains module, or module contains file stem; shortest path wins."""
    modules = imports.select("module").where("module <> ''").distinct().withColumn(
        "norm", F.lower(F.translate("module", ".\\", "//")))
    paths = files.select("file_name").withColumn("path", F.lower(F.replace("file_name", F.lit("\\"), F.lit("/")))).withColumn(
        "stem", F.lower(file_stem(F.col("file_name"))))
    rank = F.struct(F.length("file_name").alias("l"), F.col("file_name").alias("target_file"))
    norms = modules.select("norm").distinct()
    down = containing_pairs(paths.select("file_name", "path"), "path", norms, "norm").groupBy("norm").agg(F.min(rank).alias("b"))
    stems = paths.where("stem <> ''").groupBy("stem").agg(F.min(rank).alias("b"))
    up = containing_pairs(norms, "norm", stems, "stem").groupBy("norm").agg(F.min("b").alias("b"))
    best = down.unionByName(up).groupBy("norm").agg(F.min("b").alias("b"))
    return modules.join(best, "norm").select("module", "b.target_file")


def import_edges(imports: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the languages without type information, between the first nodes of two files."""
    first = nodes.groupBy("file_name").agg(F.min(F.struct("line", "node_id")).alias("f")).select("file_name", F.col("f.node_id").alias("node_id"))
    imports = imports.where(F.col("language").isin("python", "java", "javascript", "typescript", "go"))
    edges = imports.join(import_targets(imports, files), "module").where(F.col("file_name") != F.col("target_file"))
    src = first.select("file_name", F.col("node_id").alias("source_id"))
    dst = first.select(F.col("file_name").alias("target_file"), F.col("node_id").alias("target_id"))
    return edges.join(src, "file_name").join(dst, "target_file").select(
        "source_id", "target_id", F.col("file_name").alias("source_file"), "target_file", F.lit("TypeReference").alias("type"), "module", "line")


def dependency_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a corpus. The slim inputs are written once; the text is read twice in all."""
    decl = cut_lineage(declarations(files))
    imports = cut_lineage(extract_imports(files))
    nodes = cut_lineage(dep_nodes(decl))
    cols = ["source_id", "target_id", "source_file", "target_file", "type"]
    edges = call_edges(decl, nodes).select(cols).unionByName(inherit_edges(decl, nodes).select(cols)).unionByName(
        import_edges(imports, files, nodes).select(cols))
    return nodes, cut_lineage(edges)


# --- measures over an edge table ---------------------------------------------
def connectivity(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def file_maps(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Both directions as rows: a hub with many neighbours never becomes one wide row."""
    both = F.array(F.struct(F.col(src).alias("file_name"), F.lit("depends on").alias("relation"), F.col(dst).alias("other")),
                   F.struct(F.col(dst).alias("file_name"), F.lit("used by").alias("relation"), F.col(src).alias("other")))
    return edges.select(F.inline(both)).distinct()


def _ladder(cases: list[tuple[str, Column]]) -> Column:
    out = F.when(cases[0][1], cases[0][0])
    for label, cond in cases[1:]:
        out = out.when(cond, label)
    return out.otherwise("Low")


def impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What reaches each node in one step: distinct files, classes and methods."""
    source = nodes.select(F.col("node_id").alias("source_id"), F.col("kind").alias("source_kind"), F.col("full_name").alias("source_name"))
    incoming = edges.join(source, "source_id", "left").groupBy("target_id").agg(
        F.countDistinct("source_file").alias("affected_files"),
        F.countDistinct(F.when(F.col("source_kind") == "class", F.col("source_name"))).alias("affected_classes"),
        F.countDistinct(F.when(F.col("source_kind") == "method", F.col("source_name"))).alias("affected_methods"))
    degree = connectivity(edges, "source_id", "target_id")
    out = nodes.join(incoming, nodes["node_id"] == incoming["target_id"], "left").join(degree, F.col("node_id") == F.col("node"), "left")
    out = out.fillna(0, ["affected_files", "affected_classes", "affected_methods", "degree"])
    god = F.col("degree") > GOD_DEGREE
    risk = _ladder([("Critical", (F.col("affected_files") > 10) | god), ("High", F.col("affected_files") > 5), ("Medium", F.col("affected_files") > 2)])
    return out.select("node_id", "name", "kind", "file_name", "affected_files", "affected_classes", "affected_methods", "degree",
                      god.alias("is_god"), risk.alias("risk"))


def god_nodes(nodes: DataFrame, edges: DataFrame, threshold: int = GOD_DEGREE) -> DataFrame:
    degree = connectivity(edges, "source_id", "target_id").where(F.col("degree") > threshold)
    return nodes.where(F.col("kind") == "class").join(degree, F.col("node_id") == F.col("node")).select("node_id", "name", "file_name", "degree")


def file_impact(nodes: DataFrame, edges: DataFrame, cyclic_files: DataFrame) -> DataFrame:
    """Per file: union of what reaches its nodes, highest degree, cycle flag, risk ladder."""
    source = nodes.select(F.col("node_id").alias("source_id"), F.col("kind").alias("source_kind"), F.col("full_name").alias("source_name"))
    reach = edges.join(source, "source_id", "left").groupBy(F.col("target_file").alias("file_name")).agg(
        F.countDistinct("source_file").alias("affected_files"),
        F.countDistinct(F.when(F.col("source_kind") == "class", F.col("source_name"))).alias("affected_classes"),
        F.countDistinct(F.when(F.col("source_kind") == "method", F.col("source_name"))).alias("affected_methods"))
    degree = connectivity(edges, "source_id", "target_id")
    top = nodes.join(degree, F.col("node_id") == F.col("node"), "left").groupBy("file_name").agg(
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))
    cyc = cyclic_files.select(F.col("node").alias("file_name"), F.lit(True).alias("in_cycle")).distinct()
    out = top.join(reach, "file_name", "left").join(cyc, "file_name", "left").fillna(0, ["affected_files", "affected_classes", "affected_methods"])
    out = out.withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    risk = _ladder([
        ("Critical", (F.col("affected_files") > 10) | (F.col("max_degree") > 30) | F.col("in_cycle")),
        ("High", (F.col("affected_files") > 5) | (F.col("max_degree") > 20)),
        ("Medium", (F.col("affected_files") > 2) | (F.col("max_degree") > 10))])
    return out.select("file_name", "affected_files", "affected_classes", "affected_methods", "max_degree", "in_cycle", risk.alias("risk"))


# --- cycles ---------------------------------------------------------------------
def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join inside a loop: always by shuffles. A broadcast in each of some hundred joins would add up on the driver."""
    return left.join(right.hint("merge"), on, how)


def _trim_once(edges: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle: their end has no exit, or their start no entry."""
    kept = _join(edges, edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return _join(kept, edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def _follow(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists by pointer doubling: ``step`` (node, next) where ``next`` is null at a list's end.

    Returns (node, last, hops) for lists that end, and (node, label) for rings, named by their smallest node.
    Each round doubles how far every node sees, so rounds grow with the logarithm of the longest list.
    """
    far = written(step.select("node", F.coalesce("next", "node").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
                              F.least("node", F.coalesce("next", "node")).alias("least"), F.col("next").isNull().alias("ended")))
    open_, before = far.where("NOT ended").count(), None
    while open_:
        nxt = far.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("least").alias("least2"), F.col("ended").alias("ended2"))
        far = written(_join(far, nxt, "to").select("node", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("least", "least2").alias("new"), "least", "ended2")
                      .select("node", "to", "hops", F.col("new").alias("least"), F.col("ended2").alias("ended"), (F.col("new") != F.col("least")).alias("moved")))
        now = far.where("NOT ended").agg(F.count("*"), F.count_if("moved")).first()
        far = far.drop("moved")
        if (now[0], 0) == (before, now[1]):  # what is left neither ends nor learns of smaller nodes: rings
            break
        open_ = before = now[0]
    return far.where("ended").select("node", F.col("to").alias("last"), "hops"), far.where("NOT ended").select("node", F.col("least").alias("label"))


def _inner(edges: DataFrame) -> DataFrame:
    """(node, next) of the nodes with one way in and one way out."""
    ways = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.col("dst").alias("next")),
                                          F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(None).cast(edges.schema["dst"].dataType).alias("next")))).alias("w"))
    ways = ways.groupBy("w.node").agg(F.sum("w.out").alias("out"), F.sum(1 - F.col("w.out")).alias("into"), F.max("w.next").alias("next"))
    return ways.where("out = 1 AND into = 1").select("node", "next")


def _contract(edges: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold chains of ``inner`` nodes: (edges between the other nodes, chain members, rings).

    A chain becomes one edge from the node before it (``src``) to the node after it (``dst``). Members are
    (node, src, dst); rings are (node, label).
    """
    names = inner.select(F.col("node").alias("next"), F.lit(True).alias("also"))
    ended, rings = _follow(_join(inner, names, "next", "left").select("node", F.when(F.col("also"), F.col("next")).alias("next")))
    after = _join(ended.where("hops = 0").select("last"), inner.toDF("last", "after"), "last")
    is_inner = inner.select(F.col("node").alias("dst"), F.lit(True).alias("inner_dst"))
    outer = _join(_join(edges, inner.select(F.col("node").alias("src")), "src", "left_anti"), is_inner, "dst", "left")
    heads = written(_join(_join(outer.where("inner_dst").select("src", F.col("dst").alias("node")), ended.select("node", "last"), "node"), after, "last").select("last", "src", F.col("after").alias("dst")))
    members = _join(ended.select("node", "last"), heads, "last").select("node", "src", "dst")
    folded = outer.where("inner_dst IS NULL").select("src", "dst").unionByName(heads.select("src", "dst")).distinct()
    return written(folded), members, rings


def _reduce(edges: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Trim and fold while that takes a tenth of the edges away: (edges that are left, chain members by round, rings).

    A chain of any length is folded in one round; what little a further round would take is labelled like the rest.
    """
    chains, rings = [], []
    n = edges.count()
    while n:
        edges = written(_trim_once(edges))
        inner = written(_inner(edges))
        if not inner.isEmpty():
            edges, members, ring = _contract(edges, inner)
            chains.append(members)
            rings.append(ring)
        m = edges.count()
        if 10 * m > 9 * n:
            break
        n = m
    return edges, chains, rings


def cycle_members(edges: DataFrame) -> DataFrame:
    """Nodes on any cycle with their strongly connected component (named by its smallest node).

    Chains and rings are folded first, by pointer doubling, so a long chain costs its logarithm in rounds. What is
    left is labelled: forward minimum labels, then a backward walk from each label's owner, in rounds of work
    linear in the edges; labels pre-aggregate per node, so a hub node is no group in one task.
    """
    spark = edges.sparkSession
    nodes = {f.name: f.dataType for f in edges.schema.fields}["src"].simpleString()
    left, chains, rings = _reduce(written(edges.select("src", "dst").where("src <> dst").distinct()))
    found = spark.createDataFrame([], f"node {nodes}, component {nodes}")
    for ring in rings:
        found = found.unionByName(ring.select("node", F.col("label").alias("component")))
    while not left.isEmpty():
        labels = written(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")))
        while True:
            sent = _join(left, labels, left["src"] == labels["node"]).select(F.col("dst").alias("node"), "label")
            both = labels.select("node", "label", F.col("label").alias("old")).unionByName(sent, allowMissingColumns=True)
            new = written(both.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
            labels = new.select("node", "label")
            if new.where("label <> old").isEmpty():
                break
        a = labels.select(F.col("node").alias("src"), F.col("label").alias("ls"))
        b = labels.select(F.col("node").alias("dst"), F.col("label").alias("ld"))
        inside = written(_join(_join(left, a, "src"), b, "dst").where("ls = ld").select("src", "dst", F.col("ls").alias("label")))
        member = written(labels.where("node = label"))
        size = member.count()
        while True:
            back = _join(inside, member.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label")
            member = written(member.unionByName(back).distinct())
            grown = member.count()
            if grown == size:
                break
            size = grown
        # a node alone is on a cycle only where a folded chain leads back to it
        alone = _join(member, member.groupBy("label").agg(F.count("*").alias("n")).where("n = 1").select("label"), "label", "left_semi")
        loops = left.where("src = dst").select(F.col("src").alias("node"))
        found = written(found.unionByName(_join(member, _join(alone, loops, "node", "left_anti").select("node"), "node", "left_anti").select("node", F.col("label").alias("component"))))
        gone = member.select("node")
        rest, more, ring = _reduce(written(_join(_join(left, gone.withColumnRenamed("node", "src"), "src", "left_anti"), gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
        left, chains = rest, chains + more
        for r in ring:
            found = found.unionByName(r.select("node", F.col("label").alias("component")))
    # a chain lies in a component where both its ends do; chains folded last are unfolded first
    for members in reversed(chains):
        a, b = found.toDF("src", "component"), found.toDF("dst", "other")
        inner = _join(_join(members, a, "src"), b, "dst").where("component = other").select("node", "component")
        found = written(found.unionByName(inner))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return _join(found, least, "component").select("node", F.col("least").alias("component"))


def _ring_ways(member: DataFrame, e: DataFrame) -> DataFrame:
    """(component, path) of the components that are one ring each, by list ranking; ``e``: component, src, dst."""
    per = e.groupBy("component").agg(F.count("*").alias("n_edges"))
    ring = _join(member.groupBy("component").agg(F.count("*").alias("n_nodes")), per, "component").where("n_edges = n_nodes").select("component")
    step = _join(e, ring, "component", "left_semi").where("dst <> component")  # cut before the smallest node: a list that begins there
    last = _join(e, ring, "component", "left_semi").where("dst = component").select(F.col("src").alias("node"), F.lit(None).cast(e.schema["dst"].dataType).alias("next"))
    ended, _ = _follow(step.select(F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(last))
    place = _join(ended, member, "node").groupBy("component").agg(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), "node"))).alias("p"))
    return place.select("component", F.concat("p.node", F.array("component")).alias("path"))  # the answer itself lists the ring


def cycles(edges: DataFrame) -> DataFrame:
    """One row per strongly connected component: its size and one shortest cycle through its smallest node.

    A component that is one ring is read off by list ranking. For the others, a walk in levels from the smallest
    node of every component at once: a node is reached once, by its smallest parent, only the current level
    carries its way, and what was reached is one table. Of several shortest cycles the one with the
    smallest nodes, read from its end, is given.
    """
    member = written(cycle_members(edges))
    a, b = member.toDF("src", "component"), member.toDF("dst", "other")
    e = written(_join(_join(edges.select("src", "dst").where("src <> dst").distinct(), a, "src"), b, "dst").where("component = other").select("component", "src", "dst"))
    out = written(_ring_ways(member, e)).withColumnRenamed("component", "c")
    front = _join(member.where("node = component"), out, member["component"] == out["c"], "left_anti").select("component", "node", F.array("node").alias("path"))
    out = out.select(F.col("c").alias("component"), F.col("c").alias("node"), "path")
    seen = front.select("component", "node")
    while not front.isEmpty():
        step = _join(front.withColumnRenamed("node", "src"), e, ["component", "src"])
        step = step.groupBy("component", "dst").agg(F.min(F.struct("src", "path")).alias("from"))
        step = written(step.select("component", F.col("dst").alias("node"), F.concat("from.path", F.array("dst")).alias("path")))
        closed = step.where("node = component")
        out = out.unionByName(closed)
        front = written(_join(_join(step, closed.select("component"), "component", "left_anti"), seen, ["component", "node"], "left_anti"))
        seen = written(seen.unionByName(front.select("component", "node")))
    size = member.groupBy("component").agg(F.count("*").alias("n_members"))
    n = F.size("path") - 1
    return _join(out, size, "component").select("component", "n_members", F.array_join("path", " -> ").alias("cycle"), n.alias("n_nodes"),
                                              F.least(n + 1, F.lit(5)).alias("severity"))


def short_cycles(edges: DataFrame, max_len: int) -> DataFrame:
    """All elementary cycles of up to ``max_len`` nodes, each written from its smallest node.

    A listing that the caller bounds: the number of cycles grows with the power of the length. Paths start
    at the smallest member and only visit larger nodes, so each cycle is found once.
    """
    e = written(edges.select("src", "dst").where("src <> dst").distinct())
    n, m = None, e.count()
    while n != m:
        e, n = written(_trim_once(e)), m
        m = e.count()
    paths = e.where("src < dst").select(F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    out = None
    for _ in range(2, max_len + 1):
        paths = written(paths)
        step = _join(paths, e, paths["last"] == e["src"]).select("start", "path", "dst")
        closed = step.where("dst = start").select("path")
        out = closed if out is None else out.unionByName(closed)
        paths = step.where((F.col("dst") > F.col("start")) & ~F.expr("array_contains(path, dst)")).select(
            "start", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
    return out.select(F.array_join(F.concat("path", F.slice("path", 1, 1)), " -> ").alias("cycle"), F.size("path").alias("n_nodes"))


# --- reviews and contradictions ---------------------------------------------------
def peer_pairs(analyses: DataFrame) -> DataFrame:
    """Ordered reviewer/reviewee pairs per project with the number of reviews each stands for.

    Analyses are counted per (project, agent) first; a project then holds one entry per
    agent kind, so the pair list has the square of the number of agents, not of analyses.
    """
    per = analyses.groupBy("project", "agent").agg(F.count("*").alias("n"))
    sides = per.groupBy("project").agg(F.collect_list(F.struct("agent", "n")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: F.struct(
        a["agent"].alias("reviewer"), b["agent"].alias("reviewee"),
        F.when(a["agent"] == b["agent"], a["n"] * (b["n"] - 1)).otherwise(a["n"] * b["n"]).alias("n_reviews")))))
    return sides.select("project", F.inline(pairs)).where("n_reviews > 0")


def _severity_sides(findings: DataFrame) -> DataFrame:
    sev = F.upper("severity")
    return findings.where((F.col("location") != "") & sev.isin("CRITICAL", "LOW")).select(
        "finding_id", F.lit("severity at one location").alias("kind"), F.col("location").alias("key"), (sev == "CRITICAL").alias("is_left"))


def _evidence_sides(findings: DataFrame) -> DataFrame:
    cat = F.upper("category")
    left, right = cat.contains("SECURITY"), cat.contains("SAFE")
    # a category that holds both words sits on both sides
    side = F.array_compact(F.array(F.when(left, F.lit(True)), F.when(right, F.lit(False))))
    ev = F.explode(F.array_distinct(F.transform("evidence", lambda x: F.lower(x))))
    rows = findings.where(left | right).select("finding_id", ev.alias("key"), side.alias("side"))
    return rows.select("finding_id", F.lit("security against safe on one evidence").alias("kind"), "key", F.explode("side").alias("is_left"))


def contradictions(findings: DataFrame) -> DataFrame:
    """Every contradiction, grouped: one row per place with both sides counted.

    ``n_left * n_right`` is the number of contradicting pairs the row stands for; the pairs
    are never written out, so a place that holds a third of all findings stays one row.
    """
    sides = _severity_sides(findings).unionByName(_evidence_sides(findings))
    return sides.groupBy("kind", "key").agg(
        F.count_if("is_left").alias("n_left"), F.count_if(~F.col("is_left")).alias("n_right"),
        F.min(F.when(F.col("is_left"), F.col("finding_id"))).alias("first_left"),
        F.min(F.when(~F.col("is_left"), F.col("finding_id"))).alias("first_right"),
    ).where("n_left > 0 AND n_right > 0").withColumn("n_pairs", F.col("n_left") * F.col("n_right"))


def contradicted(findings: DataFrame) -> DataFrame:
    """Ids of findings that take part in any contradiction."""
    sides = _severity_sides(findings).unionByName(_evidence_sides(findings))
    open_keys = contradictions(findings).select("kind", "key")
    return sides.join(open_keys, ["kind", "key"], "left_semi").select("finding_id").distinct()
