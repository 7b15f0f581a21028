"""Paths between a concept's members and the other entities of a document, exact and sampled.

members: category, entity. triples: subject, object (directed). wikilinks: subject, object (used both ways). Queries restrict concepts and
documents first, so every join starts from the small side; all tables stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import squash
from ..work import discard, durable, likely, maybe_broadcast
from . import hops
from .numbering import numbered
from .walks import ROUND_BYTES, walked

#: Sources of a block of three_hop_counts, and pairs of a source and a target that a block counts.
SOURCES, CELLS = 1024, 1 << 24


def undirected(links: DataFrame) -> DataFrame:
    """a, b: both directions, distinct, loops and nulls left out."""
    one = links.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return one.union(one.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def _sides(members: DataFrame, context: DataFrame) -> DataFrame:
    """doc, category, target, inside, own: a row for each target; the entities of its document, and those of them that are members of the concept."""
    own = members.select("category", "entity").distinct().withColumn("_own", F.lit(True))
    per = context.select("doc", "category", "entity").join(own, ["category", "entity"], "left").groupBy("doc", "category")
    per = per.agg(F.collect_set("entity").alias("inside"), F.collect_set(F.when(F.col("_own"), F.col("entity"))).alias("own"))
    return per.select("doc", "category", F.explode(F.array_except("inside", "own")).alias("target"), "inside", "own")


def _near(wikilinks: DataFrame, nodes: DataFrame) -> DataFrame:
    """target, hop: the links in both directions whose first end is a target, distinct. Only these are shuffled, once, by the end they are joined on."""
    one = wikilinks.select(F.col("subject").alias("target"), F.col("object").alias("hop")).where("subject IS NOT NULL AND object IS NOT NULL AND subject <> object")
    both = one.union(one.select("hop", "target"))
    return likely(both, "target", nodes, "target").repartition("target").distinct()


def _steps(members: DataFrame, triples: DataFrame) -> DataFrame:
    """category, member, hop: the triples of the concepts' members, distinct."""
    step = triples.select(F.col("subject").alias("member"), F.col("object").alias("hop")).where("subject IS NOT NULL AND object IS NOT NULL")
    free = members.select("category", F.col("entity").alias("member")).distinct()
    return likely(step, "member", free, "member").repartition("member").distinct().join(free, "member")


def paths(members: DataFrame, triples: DataFrame, wikilinks: DataFrame, context: DataFrame) -> DataFrame:
    """doc, category, member, hop, target: paths concept - member - (hop) - target to the context entities of each document.

    context: doc, category, entity. hop is null for a direct link (length 1), else the object of the member's triple (length 2). Members of the concept that are in the
    document are no targets, and no path goes through an entity of the document. Documents bring their own entities along, so that the paths come out of
    the last join and are never shuffled.
    """
    side = durable(_sides(members, context), "targets")
    touching = side.join(_near(wikilinks, side), "target")
    free = members.select("category", F.col("entity").alias("hop")).distinct()
    direct = likely(touching, "hop", free, "hop").where(~F.array_contains("own", F.col("hop"))).join(free, ["category", "hop"])
    direct = direct.select("doc", "category", F.col("hop").alias("member"), F.lit(None).cast("string").alias("hop"), "target")
    via = touching.where(~F.array_contains("inside", F.col("hop"))).select("doc", "category", "target", "own", "hop").join(_steps(members, triples), ["category", "hop"])
    via = via.where(~F.array_contains("own", F.col("member")) & (F.col("member") != F.col("target")))
    return direct.unionByName(via.select("doc", "category", "member", "hop", "target"))


def tree_edges(paths_: DataFrame) -> DataFrame:
    """doc, category, src, dst, place, length, target: the annotated edges of all paths, distinct."""
    length = F.when(F.col("hop").isNull(), 1).otherwise(2)
    edge = lambda a, b, i: F.struct(a.alias("src"), b.alias("dst"), F.lit(i).alias("place"))
    c, m, h, t = (F.col(x) for x in ("category", "member", "hop", "target"))
    edges = F.when(h.isNull(), F.array(edge(c, m, 1), edge(m, t, 2))).otherwise(F.array(edge(c, m, 1), edge(m, h, 2), edge(h, t, 3)))
    return paths_.select("doc", "category", F.explode(edges).alias("e"), length.alias("length"), "target").select("doc", "category", "e.*", "length", "target").distinct()


def path_counts(paths_: DataFrame) -> DataFrame:
    """doc, category, target, length, n."""
    return paths_.groupBy("doc", "category", "target", F.when(F.col("hop").isNull(), 1).otherwise(2).alias("length")).agg(F.count("*").alias("n"))


def counted(members: DataFrame, triples: DataFrame, wikilinks: DataFrame, context: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """path_counts(paths(...)) without the paths: per target, the members that each hop next to it has, less what the document itself holds.

    context: doc, category, entity; with concepts doc, entity, each document standing with all of them. Two-step paths of a (category, target) are counted
    once for all documents; a document takes off those through its own entities and from its own members. A document's rows are shuffled once to bring
    its members and hops together and once to its targets; only rows with something to take off go further, with the numbers of the target's hops.
    """
    own = members.select("category", "entity").distinct()
    of = own.groupBy("entity").agg(F.collect_set("category").alias("of"))
    steps = durable(_steps(members, triples), "steps")
    per_hop = steps.groupBy("category", "hop").agg(F.count("*").alias("n")).groupBy("hop").agg(F.collect_list(F.struct("category", "n")).alias("w"))
    width = durable(per_hop.select("hop", (F.monotonically_increasing_id()).alias("id"), "w"), "widths")
    hops = width.count()
    known = maybe_broadcast(width, hops, 112)
    # the entities that are members or hops are few; the others only go along by name
    tags = of.join(width.select(F.col("hop").alias("entity"), "id"), "entity", "full")
    none = F.lit(None).cast
    key = ["doc"] if concepts else ["doc", "category"]
    rows = context.select(*key, "entity")
    rows = rows.select("*", none("array<string>").alias("of"), none("bigint").alias("id"), F.lit(False).alias("tagged")).union(likely(rows, "entity", tags, "entity").join(tags, "entity").select(*key, "entity", "of", "id", F.lit(True)))
    per = rows.repartition(*key).groupBy(*key).agg(F.collect_set("entity").alias("inside"), F.collect_set(F.when(F.col("tagged"), F.struct("entity", "of", "id"))).alias("tags"))
    same, others = F.filter("tags", lambda x: x["entity"] == F.col("target")), F.filter("tags", lambda x: x["entity"] != F.col("target"))
    docs = per.select(*key, F.explode("inside").alias("target"), "tags").select(*key, "target", F.get(same, F.lit(0))["of"].alias("is"), F.when(F.size(others) > 0, others).alias("rest"))
    docs = durable(docs, "targets")
    # per target its two-step paths of each category, the numbers of its hops, and the members that it is linked to
    links = _near(wikilinks, docs)
    with_width = links.join(known, "hop")
    whole = with_width.select("target", F.explode("w").alias("w")).groupBy("target", F.col("w.category").alias("category")).agg(F.sum("w.n").alias("n")).groupBy("target").agg(F.collect_list(F.struct("category", "n")).alias("whole"))
    ids = with_width.groupBy("target").agg(F.collect_list("id").alias("ids"))
    beside = likely(links, "hop", of, "entity").join(of.withColumnRenamed("entity", "hop"), "hop").groupBy("target").agg(F.collect_list(F.struct(F.col("hop").alias("member"), "of")).alias("beside"))
    fits = lambda c: (~F.coalesce(F.array_contains("is", c), F.lit(False))) & (F.lit(True) if concepts else F.col("category") == c)
    wanted = (lambda c: c.isin(concepts) & fits(c)) if concepts else fits
    at = docs.join(whole, "target", "left").join(ids, "target", "left").join(beside, "target", "left").where("whole IS NOT NULL OR beside IS NOT NULL")
    inside = F.transform(F.filter("rest", lambda x: x["id"].isNotNull()), lambda x: x["id"])
    at = durable(at.select(*key, "target", "is", "rest", "whole", "beside", F.when(F.col("rest").isNotNull(), F.array_except("ids", inside)).alias("ids"), F.when(F.col("rest").isNotNull(), F.array_intersect("ids", inside)).alias("through")), "counts")
    discard(docs)
    out = ["doc", F.col("c").alias("category"), "target"]
    given = lambda rows, c, *n: rows.select(*key, "target", "is", c.alias("c"), *n).where(wanted(F.col("c"))).select(*out, *["n"][: len(n)])
    plus = at.select("*", F.explode("whole").alias("x"))
    alone = given(plus.where("rest IS NULL"), F.col("x.category"), F.col("x.n").alias("n"))
    less = [given(plus.where("rest IS NOT NULL"), F.col("x.category"), F.col("x.n").alias("n"))]
    through = at.where("size(through) > 0").select(*key, "target", "is", F.explode("through").alias("id")).join(width.select("id", "w"), "id")
    less.append(given(through.select("*", F.explode("w").alias("x")), F.col("x.category"), (-F.col("x.n")).alias("n")))
    mine = steps.join(width.select("hop", "id"), "hop").groupBy("member", "category").agg(F.collect_list("id").alias("steps")).groupBy("member").agg(F.collect_list("category").alias("cs"), F.first("steps").alias("steps"))
    present = at.where("size(ids) > 0").select(*key, "target", "is", "ids", F.explode("rest").alias("x")).where("x.of IS NOT NULL").select(*key, "target", "is", "ids", F.col("x.entity").alias("member"))
    met = present.join(mine, "member").select("*", F.size(F.array_intersect("ids", "steps")).cast("bigint").alias("k")).where("k > 0")
    less.append(given(met.select("*", F.explode("cs").alias("x")), F.col("x"), (-F.col("k")).alias("n")))
    summed = less[0].unionByName(less[1]).unionByName(less[2]).groupBy("doc", "category", "target").agg(F.sum("n").alias("n")).where("n > 0")
    names = F.coalesce(F.transform("rest", lambda x: x["entity"]), F.array().cast("array<string>"))
    direct = at.where("beside IS NOT NULL").select("*", F.explode("beside").alias("x")).where(~F.array_contains(names, F.col("x.member")) & (F.col("x.member") != F.col("target")))
    direct = given(direct.select("*", F.explode("x.of").alias("y")), F.col("y")).groupBy("doc", "category", "target").agg(F.count("*").alias("n"))
    one, two = F.lit(1).alias("length"), F.lit(2).alias("length")
    return direct.select("doc", "category", "target", one, "n").union(alone.select("doc", "category", "target", two, "n")).union(summed.select("doc", "category", "target", two, "n"))


def path_sum(length: Column | str, n: Column | str) -> Column:
    """Aggregate: sum of 0.5 ** length * n."""
    length, n = (F.col(x) if isinstance(x, str) else x for x in (length, n))
    return F.sum(F.pow(F.lit(0.5), length) * n)


def relevance(counts: DataFrame, context: DataFrame, members: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """doc, category, connectivity, relevance: path sum over the size of the context without the concept's members, squashed; 0 without paths.

    With concepts the context is doc, entity, as in counted(), and may repeat.
    """
    if concepts:
        of = members.groupBy("entity").agg(F.collect_set("category").alias("of"))
        rows = context.select("doc", "entity")
        rows = rows.withColumn("of", F.lit(None).cast("array<string>")).union(likely(rows, "entity", of, "entity").join(of, "entity").select("doc", "entity", "of"))
        per = rows.repartition("doc").groupBy("doc").agg(F.size(F.collect_set("entity")).alias("all"), F.collect_set(F.when(F.col("of").isNotNull(), F.struct("entity", "of"))).alias("own"))
        ctx = per.select("doc", F.explode(F.array(*map(F.lit, concepts))).alias("category"), "all", "own")
        ctx = ctx.select("doc", "category", (F.col("all") - F.size(F.filter("own", lambda x: F.array_contains(x["of"], F.col("category"))))).alias("size")).where("size > 0")
    else:
        ctx = context.join(members.select("category", "entity"), ["category", "entity"], "left_anti").groupBy("doc", "category").agg(F.count("*").alias("size"))
    per = counts.groupBy("doc", "category").agg(path_sum("length", "n").alias("total"))
    out = ctx.join(per, ["doc", "category"], "left").withColumn("c", F.coalesce("total", F.lit(0.0)) / F.col("size"))
    return out.select("doc", "category", F.round("c", 6).alias("connectivity"), F.round(squash("c"), 6).alias("relevance"))


def _place(seed: int, salt: int, key: list[str], n: str) -> Column:
    """A number from 1 to n that depends on the seed, the salt and the key alone: 32 bits of an MD5, so that other engines can name it too."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(salt)), *(F.col(c).cast("string") for c in key))
    return (F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.col(n)) + 1).cast("int")


def _numbered(df: DataFrame, group: list[str], node: str, salt: int) -> DataFrame:
    """Distinct (group, node) with i{salt}, from 1 in the order of the node, and n{salt}, how many the group has."""
    w = W.partitionBy(*group)
    return df.select(*group, node).distinct().withColumn(f"i{salt}", F.row_number().over(w.orderBy(node))).withColumn(f"n{salt}", F.count("*").over(w))


def _coded(members: DataFrame) -> DataFrame:
    """member, code: numbers in the order of the names."""
    return durable(numbered(members.select("member").distinct(), ["member"]), "codes")


def _ends(found: DataFrame, codes: DataFrame, key: list[str]) -> DataFrame:
    """The walks with their members' names, and the probability in the order of the steps."""
    p = F.lit(1.0)
    for n in ("n1", "n2", "n3"):
        p = p / F.col(n)
    out = found.join(codes, "code").withColumn("probability", p)
    return out.select(*key, "walk", "member", F.when(F.col("hop") != "", F.col("hop")).alias("hop"), *([] if "target" in key else ["target"]), "probability", F.floor(1 / F.col("probability") + 1e-6).alias("estimate"), "paths")


def random_walks(paths_: DataFrame, walks: int = 50, seed: int = 0, key: tuple[str, ...] = ("doc", "category"), per_group: DataFrame | None = None) -> DataFrame:
    """key, walk, member, hop, target, probability, estimate: seeded walks down the tree of all paths of a group (key).

    Each step picks evenly among the next nodes from which a target is still reached, by the number that the hash of (seed, key, walk) names; estimate is
    1 / probability as a whole number. The same seed gives the same rows whatever the partitioning. per_group (key, walks) gives each group a number of
    walks of its own. For paths that are at hand; PathTrees walks without listing them.
    """
    k = list(key)
    codes = _coded(paths_)
    per = paths_.withColumn("hop", F.coalesce("hop", F.lit(""))).join(codes, "member").groupBy(*dict.fromkeys([*k, "hop", "target"])).agg(F.collect_set("code").alias("ms"))
    per = per.withColumn("walks", F.lit(walks)) if per_group is None else per.join(per_group, k)
    return _ends(walked(per, k, seed), codes, k).drop("paths")


class PathTrees:
    """The trees of paths(...) of each document, for walks: a row for each hop and target next to it, to which the hop's members are joined as codes.

    Rounds of documents bound what one shuffle holds (walks.ROUND_BYTES); the walks of a round are written before the next begins.
    """

    def __init__(self, members: DataFrame, triples: DataFrame, wikilinks: DataFrame, context: DataFrame):
        self.codes = _coded(members.select(F.col("entity").alias("member")))
        free = members.select("category", F.col("entity").alias("member")).distinct().join(self.codes, "member").select("category", "member", "code")
        side = durable(_sides(members, context).withColumn("size", F.size("inside")), "targets")
        present = side.select("doc", "category", F.explode("own").alias("member")).distinct().join(free, ["category", "member"]).groupBy("doc", "category").agg(F.collect_set("code").alias("lacks"))
        near = side.join(_near(wikilinks, side), "target").where(~F.array_contains("inside", F.col("hop")))
        steps = _steps(members, triples).join(self.codes, "member")
        self.lists = durable(steps.groupBy("category", "hop").agg(F.collect_list("code").alias("ms")), "members_of_hops")
        self.near = durable(near.select("doc", "category", "target", "hop", "size").join(present, ["doc", "category"], "left"), "near")
        own = free.select("category", F.col("member").alias("hop"), "code")
        direct = likely(self.near, "hop", own, "hop").join(own, ["category", "hop"]).groupBy("doc", "category", "target").agg(F.first("size").alias("size"), F.collect_set("code").alias("ms"))
        self.direct = durable(direct.select("doc", "category", "target", F.lit("").alias("hop"), "size", "ms"), "direct")
        held = self.lists.agg(F.count("*").alias("n"), F.sum(F.size("ms")).alias("codes")).first()
        self.rounds = 1 + int(self.near.count() * (held["codes"] or 0) * 4 / max(1, held["n"]) / ROUND_BYTES)

    def trees(self, r: int | None = None) -> DataFrame:
        """doc, category, target, hop, size, ms of a round's documents, or of all; size: the number of the document's entities."""
        mine = lambda df: df if r is None else df.where(F.pmod(F.xxhash64("doc"), F.lit(self.rounds)) == r)
        ms = F.when(F.col("lacks").isNull(), F.col("ms")).otherwise(F.array_except("ms", "lacks"))
        via = mine(self.near).join(self.lists, ["category", "hop"]).select("doc", "category", "target", "hop", "size", ms.alias("ms")).where(F.size("ms") > 0)
        return via.unionByName(mine(self.direct))

    def edges(self) -> DataFrame:
        """As tree_edges over all paths. Only the first step repeats: a member comes by several hops, so the codes go to their target, and names are joined last."""
        t = self.trees()
        at = ["doc", "category", "target"]
        names = maybe_broadcast(self.codes, self.codes.count())
        step = lambda df, a, b, i, n: df.select("doc", "category", a.alias("src"), b.alias("dst"), F.lit(i).alias("place"), F.lit(n).alias("length"), "target")
        c, m, h, e = (F.col(x) for x in ("category", "member", "hop", "target"))
        named = lambda df: df.withColumn("code", F.explode("ms")).drop("ms").join(names, "code")
        via, direct = t.where("hop <> ''").select(*at, "hop", "ms"), named(t.where("hop = ''").select(*at, "ms"))
        first = named(via.repartition(*at).groupBy(*at).agg(F.array_distinct(F.flatten(F.collect_list("ms"))).alias("ms")))
        out = step(direct, c, m, 1, 1).union(step(direct, m, e, 2, 1))
        return out.union(step(first, c, m, 1, 2)).union(step(named(via), m, h, 2, 2)).union(step(via, h, e, 3, 2))

    def _each(self, walks: Column | int, seed: int, key: list[str], summed: bool = False) -> DataFrame:
        walks = walks if isinstance(walks, Column) else F.lit(walks)
        parts = [walked(self.trees(r).withColumn("walks", walks).drop("size"), key, seed, summed) for r in range(self.rounds)]
        parts = [durable(p, "walks") for p in parts]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def walks(self, walks: int = 50, seed: int = 0, key: tuple[str, ...] = ("doc", "category")) -> DataFrame:
        """As random_walks over all paths, with paths, their number in the group."""
        return _ends(self._each(walks, seed, list(key)), self.codes, list(key))

    def collective(self, context: DataFrame, per_entity: int = 500, seed: int = 0) -> DataFrame:
        """As collective_walks over all paths; the walks are added up where they end."""
        ctx = context.select("doc", "category", F.col("entity").alias("target")).distinct()
        got = self._each(F.col("size") * per_entity, seed, ["doc", "category"], True)
        per = durable(got.groupBy("doc", "category", "target").agg(F.sum("hits").alias("hits"), F.sum("weight").alias("weight")), "hits")
        return _shares(ctx, per.groupBy("doc", "category").agg(F.sum("hits").alias("walks")), per)


def blind_walks(members: DataFrame, triples: DataFrame, wikilinks: DataFrame, context: DataFrame, walks: int = 600, seed: int = 0) -> DataFrame:
    """doc, category, walk, success, probability, estimate: walks of one or two steps from a random member without the tree; dead ends count as 0.

    Each node's neighbours are numbered once; a step joins the walk to the neighbour whose number the hash of (seed, doc, category, walk) names.
    """
    start = context.select("doc", "category").distinct().withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))))

    def step(now: DataFrame, edges: DataFrame, at: str, to: str, salt: int) -> DataFrame:
        near = durable(_numbered(edges, [at], to, salt), "near")
        size = near.select(at, f"n{salt}").distinct()
        place = _place(seed, salt, ["doc", "category", "walk"], f"n{salt}")
        now = now.join(size, at).withColumn(f"i{salt}", place).join(near.drop(f"n{salt}"), [at, f"i{salt}"])
        return now.withColumn("p", F.col("p") / F.col(f"n{salt}")).drop(f"i{salt}", f"n{salt}")

    at = step(start.withColumn("p", F.lit(1.0)), members.select("category", F.col("entity").alias("member")), "category", "member", 1)
    at = at.withColumn("node", F.col("member")).withColumn("sides", F.lit(2))
    two = _place(seed, 9, ["doc", "category", "walk"], "sides") == 2
    via = step(at.where(two), triples.select(F.col("subject").alias("node"), F.col("object").alias("mid")).where("node IS NOT NULL AND mid IS NOT NULL"), "node", "mid", 2).withColumn("node", F.col("mid")).drop("mid")
    end = step(at.where(~two).unionByName(via), undirected(wikilinks).select(F.col("a").alias("node"), F.col("b").alias("target")), "node", "target", 3)
    hit = context.select("doc", "category", F.col("entity").alias("target")).distinct().join(members.select("category", F.col("entity").alias("target")), ["category", "target"], "left_anti")
    end = end.join(hit, ["doc", "category", "target"], "left_semi").select("doc", "category", "walk", "p")
    out = start.join(end, ["doc", "category", "walk"], "left")
    return out.select("doc", "category", "walk", F.col("p").isNotNull().alias("success"), F.coalesce("p", F.lit(0.0)).alias("probability"), F.coalesce(F.floor(2 / F.col("p") + 1e-6), F.lit(0)).alias("estimate"))


def targeted_walks(paths_: DataFrame, tries: int = 10, seed: int = 0) -> DataFrame:
    """As random_walks, but so many walks for each target, over the paths to it alone."""
    return random_walks(paths_, tries, seed, ("doc", "category", "target"))


def collective_walks(paths_: DataFrame, context: DataFrame, per_entity: int = 500, seed: int = 0) -> DataFrame:
    """doc, category, target, walks, hits, estimate: walks over the whole tree, per_entity times the number of the group's context entities, with 0 for those not hit."""
    ctx = context.select("doc", "category", F.col("entity").alias("target")).distinct()
    got = durable(random_walks(paths_, 0, seed, per_group=ctx.groupBy("doc", "category").agg((F.count("*") * per_entity).alias("walks"))), "walks")
    total = got.groupBy("doc", "category").agg(F.count("*").alias("walks"))
    return _shares(ctx, total, got.groupBy("doc", "category", "target").agg(F.count("*").alias("hits"), F.sum("estimate").alias("weight")))


def _shares(ctx: DataFrame, total: DataFrame, per: DataFrame) -> DataFrame:
    out = ctx.join(total, ["doc", "category"]).join(per, ["doc", "category", "target"], "left")
    return out.select("doc", "category", "target", "walks", F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("weight", F.lit(0)) / F.col("walks")).alias("estimate"))


def running_error(samples: DataFrame, key: list[str], order: list[str], value: str, truth: str) -> DataFrame:
    """samples with n, running_sum, running_mean and running_error (relative to truth, two digits; null where truth is 0)."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = samples.withColumn("n", F.count("*").over(w)).withColumn("running_sum", F.round(F.sum(value).over(w), 2))
    mean = F.col("running_sum") / F.col("n")
    return out.withColumn("running_mean", mean).withColumn("running_error", F.when(F.col(truth) != 0, F.round(F.abs(mean - F.col(truth)) / F.col(truth), 2)))


def common_neighbours(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, linked, common: for pairs of entities, whether a link joins them and how many neighbours they share."""
    u = undirected(links)
    mid = pairs.join(u.select("a", F.col("b").alias("m")), "a").join(u.select(F.col("a").alias("b"), F.col("b").alias("m")), ["b", "m"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    out = pairs.join(u.withColumn("linked", F.lit(1)), ["a", "b"], "left").join(mid, ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("common", F.lit(0)).alias("common"))


def three_hop_counts(links: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target, one, two, three: walks of one to three links between sources and targets that don't pass through either end; pairs with any walk.

    Walks are counted, not listed: the links of nodes next to a source or target are packed by their other ends and written once; sources go in blocks, and the task of a
    block reads them piece by piece and counts its walks (hops.counting). A block has at most SOURCES sources and, together with the targets that have links, CELLS counts,
    one source at least. Sources are put in blocks by length and name, so that ids near each other share neighbours.
    """
    spark = links.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * links.count() // hops.PIECE)
    one = links.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    both = one.union(one.select("b", "a")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    s = sources.select(F.col("source").alias("a")).where("a IS NOT NULL").distinct()
    first = durable(both.join(maybe_broadcast(s, s.count()), "a").distinct(), "first")
    ends = first.select(F.col("b").alias("node"), F.lit(1).alias("rest")).union(targets.where("target IS NOT NULL").select("target", F.lit(0)))
    ends = ends.groupBy("node").agg(F.min("rest").alias("rest")).withColumn("n", F.length(F.col("node").cast("string")))
    ends = durable(numbered(ends, ["rest", "n", "node"]).select("node", F.col("code").cast("int").alias("code"), "rest"), "ends")  # targets have the first numbers
    n_codes, n_targets = ends.agg(F.count("*"), F.count_if(F.col("rest") == 0)).first()
    aims = maybe_broadcast(ends.where("rest = 0").select(F.col("node").alias("a"), F.col("code").alias("own")), n_targets)
    coded = maybe_broadcast(ends.select(F.col("node").alias("b"), "code"), n_codes)
    pairs = both.join(coded, "b").join(aims, "a", "left").select("a", "code", F.coalesce("own", F.lit(-1)).alias("own"))
    packed = durable(pairs.repartition(parts, "a").mapInArrow(hops.packing, hops.PACKED), "packed")
    width = packed.mapInArrow(hops.aims(n_targets), "t int").distinct().count()
    size = max(1, min(SOURCES, CELLS // max(1, width)))
    s = numbered(first.select("a", F.length(F.col("a").cast("string")).alias("n")).distinct(), ["n", "a"]).select("a", F.floor(F.col("code") / size).cast("int").alias("block"))
    s = durable(s, "blocks")
    n_sources = s.count()
    first = first.join(maybe_broadcast(s, n_sources), "a").join(coded, "b").join(aims, "a", "left")
    first = first.select("block", F.col("a").alias("source"), F.coalesce("own", F.lit(-1)).alias("own"), "code").repartitionById(max(1, -(-n_sources // size)), F.col("block"))
    kind = first.schema["source"].dataType.simpleString()
    found = first.select("source", "own", "code").mapInArrow(hops.counting(packed._rollstone_path, n_codes, n_targets, width), f"source {kind}, {hops.COUNTS}")
    return found.join(maybe_broadcast(ends.where("rest = 0").select(F.col("node").alias("target"), F.col("code").alias("t")), n_targets), "t").select("source", "target", "one", "two", "three")


def reachable(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, node, distance: level-wise search from all roots at once, up to depth links; the root itself has distance 0."""
    u = durable(undirected(links), "links")
    seen = durable(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("distance")), "seen")
    for d in range(1, depth + 1):
        front = seen.where(F.col("distance") == d - 1)
        new = front.join(u.select(F.col("a").alias("node"), F.col("b").alias("next")), "node").select("root", F.col("next").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        new = durable(new.withColumn("distance", F.lit(d)), "front")
        if not new.limit(1).count():
            break
        grown = durable(seen.unionByName(new), "seen")
        discard(seen)
        seen = grown
    return seen


def connected(links: DataFrame, nodes: list, depth: int) -> bool:
    """Whether the nodes are in one component of what they reach within depth links, ways between them included; one node is connected."""
    if len(set(nodes)) < 2:
        return True
    from .components import components

    spark = links.sparkSession
    kind = links.schema["subject"].dataType.simpleString()
    roots = spark.createDataFrame([(n,) for n in set(nodes)], f"root {kind}")
    near = reachable(links, roots, depth).select("node").distinct()
    u = undirected(links).join(near.select(F.col("node").alias("a")), "a", "left_semi").join(near.select(F.col("node").alias("b")), "b", "left_semi")
    of = components(u).where(F.col("node").isin(list(set(nodes))))
    got = of.agg(F.count("*"), F.count_distinct("component")).first()
    return got[0] == len(set(nodes)) and got[1] == 1


def degrees(links: DataFrame) -> DataFrame:
    """node, degree: distinct neighbours in both directions."""
    return undirected(links).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def sample_errors(walks: DataFrame, counts: DataFrame) -> DataFrame:
    """doc, category, truth, estimate: exact number of paths beside the mean of the walks' estimates."""
    truth = counts.groupBy("doc", "category").agg(F.sum("n").alias("truth"))
    mean = walks.groupBy("doc", "category").agg(F.avg("estimate").alias("estimate"))
    return truth.join(mean, ["doc", "category"])


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows by the order of a seeded hash of the key: the same rows whatever the partitioning (a sampling operator)."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in key)))).orderBy("_h", *key).limit(n).drop("_h")


def prefixed_walks(paths_: DataFrame, prefix: list[str], tries: int = 50, seed: int = 0) -> DataFrame:
    """random_walks whose first nodes are given (a member, or a member and a hop): the probability counts from the end of the prefix."""
    held = paths_
    for c, v in zip(("member", "hop"), prefix):
        held = held.where(F.col(c) == v)
    return random_walks(held, tries, seed)
