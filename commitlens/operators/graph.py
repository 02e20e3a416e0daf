"""Developer graphs and their betweenness.

Vertices with the same neighbours are kept as one class with a multiplicity.
Every shortest path runs through classes in the same way whichever members it
takes, so scores stay exact while the many developers who touched only one hot
file, or the many files of one large commit, shrink to single vertices.  Pairs
are formed between classes only, never between all members of a group.

Column ``graph`` names the graph a row belongs to.  All graphs are solved together in tiles:
a tile has some of a graph's sources and a block of its vertices with their links, as many as
``TILE`` allows, and a graph has as many tiles as it needs.  Tiles tell each other what crosses from one
block to another, in steps, until nothing does.  Sources take turns, so that what all tiles keep at a time
stays within ``STATE_ROWS`` pairs (source, vertex), and no source is left out.

For ``contribution`` a graph that fits into one tile as it is needs neither classes nor numbers: a task solves it
whole from its touches, and classes are formed for the larger ones only.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.names import unpacked
from commitlens.functions.paths import path_whitelist
from commitlens.operators import dag, history, tiles
from commitlens.operators.change import for_requests
from commitlens.schemas import AUTHOR, CHANGE_KEY
from commitlens.session import Rounds, cut

# Each unordered pair of vertices is met once from either end.
PAIR_SHARE = 0.5

# Pairs (source, vertex) that all tiles may keep at a time.
STATE_ROWS = 10_000_000_000

# Links, and pairs (source, vertex), of one tile.
TILE = (1 << 17, 1 << 20)

TILE_ROWS = "g bigint, part bigint, block bigint, kind string, a bigint, b bigint, c bigint, d bigint, x double, state binary"


def _fingerprint(*columns):
    """Order-free digest of a group's rows, built with partial aggregation."""
    return F.struct(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(*columns)).alias("a"),
        F.bit_xor(F.xxhash64(F.lit("second"), *columns)).alias("b"),
    )


def _classes(rows: DataFrame, member: str, neighbour: list[str], name: str) -> DataFrame:
    """(graph, member, class): members with equal neighbour rows share a class.

    A class is named by its least member.
    """
    digests = rows.groupBy("graph", member).agg(_fingerprint(*neighbour).alias("digest"))
    named = digests.groupBy("graph", "digest").agg(F.min(member).alias(name))
    return digests.join(named, ["graph", "digest"]).select("graph", member, name)


def author_touches(t, requests=None, whitelist=None, merges=None) -> DataFrame:
    """Whitelisted (graph, path, author) touches with their number of commits.

    ``whitelist`` may hold ``names`` and ``extensions``, lists of regular expressions.
    One graph per project over its whole history or, with requests, one per
    requested (project, sha) over the history up to that commit: in linear order or,
    with ``merges``, as far as it is reachable.
    """
    allowed = whitelist or {}
    kept = t.changes.filter(
        path_whitelist(F.col("path"), allowed.get("names"), allowed.get("extensions"))
    )
    touched = history.touches(kept, t.commits).withColumn("author", F.struct(*AUTHOR))
    if requests is None:
        rows = touched.withColumn("graph", F.struct("project_id", F.lit(None).cast("string").alias("sha")))
    elif dag.by_reach(t, merges):
        by_name = dag.by_bytes(kept.select(*CHANGE_KEY)).join(dag.by_bytes(t.commits.select("project_id", "sha", *AUTHOR)), ["project_id", "sha"])
        rows = dag.Reached(t, dag.by_bytes(requests.select("project_id", "sha")), names_packed=True).join(
            by_name.withColumn("author", F.struct(*AUTHOR))
        ).withColumn("graph", F.struct("project_id", unpacked(F.col("till_sha")).alias("sha")))
    else:
        tills = (
            requests.select("project_id", "sha")
            .distinct()
            .join(t.commits.select("project_id", "sha", F.col("seq").alias("till")), ["project_id", "sha"])
            .withColumnRenamed("sha", "till_sha")
        )
        rows = (
            history.join_until(tills, touched, ["project_id"])
            .withColumn("graph", F.struct("project_id", F.col("till_sha").alias("sha")))
        )
    return rows.groupBy("graph", "path", "author").agg(F.count(F.lit(1)).alias("weight"))


def numbered(vertices: DataFrame) -> DataFrame:
    """Give every vertex of every graph a number of its own, as column ``id``.

    Numbers depend on where rows lie, so both sides of the step are fixed.
    """
    return cut(cut(vertices).withColumn("id", F.monotonically_increasing_id()))


def betweenness(vertices: DataFrame, edges: DataFrame, state_rows: int = STATE_ROWS, tile=TILE, of_edges: bool = True):
    """Edge scores (u, v, score) and vertex scores (id, score) of all graphs.

    ``vertices`` has (graph, id, size) and ``edges`` each edge once as (graph, u, v, w),
    w > 0.  Vertices without an edge have no score.  Edge scores are None if not asked for.
    """
    one_way = edges.select("u", "v", "w")
    both = cut(one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    degrees = both.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    linked = cut(vertices.select("graph", "id", "size").join(degrees, "id"))
    graphs = linked.groupBy("graph").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("degree").alias("m"))
    blocks = F.ceil(F.col("m") / tile[0])
    graphs = graphs.select("graph", "g", "n", blocks.alias("blocks"), F.ceil(F.col("n") * F.col("n") / blocks / tile[1]).alias("parts"))
    placed = cut(
        linked.join(graphs, "graph").select(
            "g", "id", "size", "blocks", "parts",
            F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"),
            F.pmod(F.xxhash64("id", F.lit("source")), F.col("parts")).alias("part"),
        )
    )
    squares = graphs.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    turns = -(-squares // state_rows) or 1
    every_part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    near = placed.select(F.col("id").alias("u"), "g", "block", "parts", (F.col("blocks") > 1).alias("many"))
    far = placed.select(F.col("id").alias("v"), F.col("block").alias("to"))
    fixed = cut(
        _rows(placed, "vertex", "g", every_part, "block", a="id", d="size", many=F.col("blocks") > 1).unionByName(
            _rows(both.join(near, "u").join(far, "v"), "edge", "g", every_part, "block", a="u", b="v", c="to", d="w", many="many")
        )
    )
    found = []
    for turn in range(turns):
        mine = placed.filter(F.pmod(F.xxhash64("id", F.lit("turn")), F.lit(turns)) == turn)
        every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
        found.append(_solved(fixed.unionByName(_rows(mine, "source", "g", "part", every_block, a="id", d="size", many=F.col("blocks") > 1)), of_edges))
    scores = cut(reduce(DataFrame.unionByName, found).groupBy("a", "b").agg((F.sum("x") * PAIR_SHARE).alias("score")))
    of_vertices = scores.filter(F.col("a") == F.col("b")).select(F.col("a").alias("id"), "score")
    if not of_edges:
        return None, of_vertices
    ends = one_way.select("u", "v", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return scores.join(ends, ["a", "b"]).select("u", "v", "score"), of_vertices


def _rows(df, kind, *place, many, **columns):
    """Rows of one kind for the tiles (g, part, block): numbers a, b, c and d, a value x, a packed state."""
    types = {"a": "bigint", "b": "bigint", "c": "bigint", "d": "bigint", "x": "double", "state": "binary"}
    asked = [(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return df.select(*place, F.lit(kind).alias("kind"), *asked, (F.col(many) if isinstance(many, str) else many).alias("many"))


def _solved(rows: DataFrame, of_edges: bool) -> DataFrame:
    """(a, b, x): what the paths from the sources in ``rows`` add to vertices (a = b) and edges.

    A tile without links to others is finished in the first step.  The others work in steps: each carries
    what has changed through its own links as far as it goes and tells other tiles what leaves it; a
    phase ends when no tile has anything to tell.
    """
    rounds, scores = Rounds("tiles"), []
    keys = ["g", "part", "block"]

    def step(given, phase, start):
        out = given.drop("many").groupBy(*keys).applyInArrow(lambda key, table: tiles.solve(key, table, phase, start, of_edges), TILE_ROWS)
        out = rounds.put(out)
        scores.append(cut(out.filter("kind = 'score'").select("a", "b", "x")))
        return out

    out = step(rows, "distance", True)
    rows = rows.filter("many")
    if out.filter("kind = 'state'").isEmpty():
        return scores[0]
    for phase in ("distance", "paths", "beyond", "score"):
        start = phase != "distance"
        while start or not out.filter("kind = 'message'").isEmpty():
            told = out.filter("kind = 'message'")
            if phase == "distance":
                told = told.groupBy(*keys, "kind", "a", "b").agg(F.min("d").alias("d"))
            elif phase != "score":
                told = told.groupBy(*keys, "kind", "a", "b", "d").agg(F.sum("x").alias("x"))
            given = rows.unionByName(out.filter("kind = 'state'"), allowMissingColumns=True)
            out = step(given.unionByName(told, allowMissingColumns=True), phase, start)
            start = False
    return reduce(DataFrame.unionByName, scores)


def developer_classes(touches: DataFrame) -> DataFrame:
    """(graph, author, v): the class, named by its least member, of every developer."""
    return _classes(touches, "author", ["path"], "v")


def collaboration_classes(touches: DataFrame):
    """Developer classes, and for each group of files with the same classes its pairs.

    Returns ``(developers, files, members)``: ``developers`` (graph, v, size),
    ``files`` (graph, path, bundle) and ``members`` (graph, bundle, v).
    """
    touches = cut(touches)
    of_author = cut(developer_classes(touches))
    developers = of_author.groupBy("graph", "v").agg(F.count(F.lit(1)).alias("size"))
    by_class = cut(touches.join(of_author, ["graph", "author"]).select("graph", "path", "v").distinct())
    files = cut(_classes(by_class, "path", ["v"], "bundle"))
    # The bundle is named by one of its paths, whose rows describe them all.
    members = by_class.withColumnRenamed("path", "bundle").join(
        files.select("graph", "bundle").distinct(), ["graph", "bundle"], "left_semi"
    )
    return developers, files, members


def class_pairs(members: DataFrame) -> DataFrame:
    """(graph, bundle, u, v) with u < v: classes that share the files of a bundle."""
    left = members.withColumnRenamed("v", "u")
    return left.join(members, ["graph", "bundle"]).filter(F.col("u") < F.col("v"))


def collab_edges(t, requests=None, whitelist=None, merges=None, **options) -> DataFrame:
    """Edges of the developer graph in long form, one row per edge and shared file.

    An edge between classes u and v stands for ``size_u * size_v`` developer
    pairs, one from u to itself for the pairs within the class.
    """
    developers, files, members = collaboration_classes(author_touches(t, requests, whitelist, merges))
    sizes = developers.select("graph", F.col("v").alias("u"), F.col("size").alias("size_u"))
    across = class_pairs(members)
    within = (
        members.join(developers.filter(F.col("size") > 1), ["graph", "v"])
        .select("graph", "bundle", F.col("v").alias("u"), "v")
    )
    return (
        across.select("graph", "bundle", "u", "v")
        .unionByName(within)
        .join(files, ["graph", "bundle"])
        .join(sizes, ["graph", "u"])
        .join(developers.withColumnRenamed("size", "size_v"), ["graph", "v"])
        .select("graph", "u", "v", "size_u", "size_v", "path")
    )


def collaboration(
    t, requests=None, whitelist=None, merges=None, state_rows=STATE_ROWS, tile=TILE, **options
) -> DataFrame:
    """Per path the greatest edge betweenness among developers who share it.

    Null for a path that fewer than two developers touched.
    """
    developers, files, members = collaboration_classes(author_touches(t, requests, whitelist, merges))
    vertices = numbered(developers)
    bundles = numbered(files.select("graph", "bundle").distinct()).withColumnRenamed("id", "b")
    inside = cut(
        members.join(vertices.select("graph", "v", "id", "size"), ["graph", "v"])
        .join(bundles, ["graph", "bundle"])
        .select("graph", "b", "id", "size")
    )
    pairs = cut(
        inside.select("graph", "b", F.col("id").alias("u"))
        .join(inside.select("b", F.col("id").alias("v")), "b")
        .filter(F.col("u") < F.col("v"))
    )
    edges = cut(pairs.select("graph", "u", "v").distinct().withColumn("w", F.lit(1).cast("bigint")))
    scored, _ = betweenness(vertices, edges, state_rows, tile)
    across = pairs.join(scored, ["u", "v"]).select("b", "score")
    # Two members of one class are linked directly and serve no other pair.
    within = inside.filter(F.col("size") > 1).select("b", F.lit(1.0).alias("score"))
    best = across.unionByName(within).groupBy("b").agg(F.max("score").alias("collaboration"))
    scores = (
        files.join(bundles, ["graph", "bundle"])
        .join(best, "b", "left")
        .select("graph", "path", "collaboration")
    )
    return _of_paths(scores, requests)


def _of_paths(scores: DataFrame, requests) -> DataFrame:
    measures = scores.select(
        "graph.project_id", "graph.sha", *[c for c in scores.columns if c != "graph"]
    )
    if requests is None:
        return measures.drop("sha")
    return for_requests(measures, requests, ["project_id", "sha", "path"])


def contrib_edges(t, requests=None, whitelist=None, merges=None, **options) -> DataFrame:
    """Developer-file edges with the number of commits as weight, files whitelisted."""
    return author_touches(t, requests, whitelist, merges)


def _by_whole_graphs(touches: DataFrame, cells: int, links: int):
    """Scores (graph, path, contribution) of the graphs that a task solves as they are, and the other graphs' touches or None.

    Such a graph has up to ``links`` links and ``cells`` pairs of vertices, by estimates: they decide the way, not the
    scores.  One with files without a name goes the way of classes.
    """
    vertices = F.approx_count_distinct("path") + F.approx_count_distinct("author")
    sizes = touches.groupBy("graph").agg(F.count(F.lit(1)).alias("m"), F.count("path").alias("named"), vertices.alias("n"))
    large = cut(sizes.filter(~((F.col("m") * 2 <= links) & (F.col("n") * F.col("n") <= cells) & (F.col("m") == F.col("named")))).select("graph"))
    whole, others = touches, None
    if not large.isEmpty():
        whole, others = cut(touches.join(large, "graph", "left_anti")), cut(touches.join(large, "graph", "left_semi"))
    kind = touches.select("graph", "path", F.lit(0.0).alias("contribution")).schema
    solved = whole.groupBy("graph").applyInArrow(tiles.of_files, kind)
    return solved.withColumn("contribution", F.col("contribution") * PAIR_SHARE), others


def _by_classes(touches: DataFrame, state_rows, tile) -> DataFrame:
    """Scores (graph, path, contribution) of graphs of any size."""
    authors = cut(_classes(touches, "author", ["path", "weight"], "author_class"))
    files = cut(_classes(touches, "path", ["author", "weight"], "path_class"))
    nobody = F.lit(None).cast(touches.schema["author"].dataType)
    nothing = F.lit(None).cast("string")
    vertices = numbered(
        authors.select("graph", F.col("author_class").alias("author"), nothing.alias("path"))
        .unionByName(files.select("graph", nobody.alias("author"), F.col("path_class").alias("path")))
        .groupBy("graph", "author", "path")
        .agg(F.count(F.lit(1)).alias("size"))
    )
    author_ids = vertices.filter(F.col("author").isNotNull()).select(
        "graph", F.col("author").alias("author_class"), F.col("id").alias("u")
    )
    file_ids = vertices.filter(F.col("path").isNotNull()).select(
        "graph", F.col("path").alias("path_class"), F.col("id").alias("v")
    )
    # A class is named by one of its members, so that member's edges are the class's.
    one_way = (
        touches.select("graph", F.col("author").alias("author_class"), F.col("path").alias("path_class"), "weight")
        .join(author_ids, ["graph", "author_class"])
        .join(file_ids, ["graph", "path_class"])
        .select("graph", "u", "v", F.col("weight").alias("w"))
    )
    edges = cut(one_way)
    _, through = betweenness(vertices, edges, state_rows, tile, of_edges=False)
    # Members of one class reach each other over their nearest neighbours.
    twins = vertices.filter(F.col("size") > 1).select(F.col("id").alias("u"), F.col("size").alias("twins"))
    ways = edges.select("u", "v", "w").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    )
    nearest = ways.join(twins, "u").groupBy("u", "twins").agg(F.min("w").alias("w"))
    between = cut(ways.join(nearest, ["u", "w"]).join(vertices.select(F.col("id").alias("v"), "size"), "v"))
    routes = between.groupBy("u").agg(F.sum("size").alias("routes"))
    shared = between.join(routes, "u").select(
        F.col("v").alias("id"),
        (F.col("twins") * (F.col("twins") - 1) / F.col("routes") * PAIR_SHARE).alias("score"),
    )
    scores = through.unionByName(shared).groupBy("id").agg(F.sum("score").alias("score"))
    return (
        files.join(file_ids.withColumnRenamed("v", "id"), ["graph", "path_class"])
        .join(scores, "id", "left")
        .select("graph", "path", F.coalesce("score", F.lit(0.0)).alias("contribution"))
    )


def contribution(
    t, requests=None, whitelist=None, merges=None, closeness=False,
    state_rows=STATE_ROWS, tile=TILE, **options
) -> DataFrame:
    """Weighted betweenness of every file in the developer-file graph.

    The number of commits is the length of an edge.  ``closeness=True`` turns it
    round: the more commits, the shorter the edge.
    """
    touches = author_touches(t, requests, whitelist, merges)
    if closeness:
        most = touches.groupBy("graph").agg(F.max("weight").alias("most"))
        touches = touches.join(most, "graph").select(
            "graph", "path", "author", (F.col("most") + 1 - F.col("weight")).alias("weight")
        )
    measured, others = _by_whole_graphs(cut(touches), min(tile[1], state_rows), tile[0])
    if others is not None:
        measured = measured.unionByName(_by_classes(others, state_rows, tile))
    return _of_paths(measured, requests)
