"""Reachability in histories with merges.

History is cut into chains of first parents: each commit is followed by at most
one child in its chain.  Whoever reaches a commit reaches everything below it in
its chain, so what a commit reaches is one position per chain instead of a list
of commits, and a search steps from chain to chain instead of commit to commit.

An index keeps what is reached without a row per commit and chain.  Every chain but the first
stands on a place in another; ``ladder`` has all the places below it, few because of the heaviest
children.  Beyond those a chain reaches what its merges bring in: ``takes`` has a row for every piece of
another chain that a merge adds to what was reached before.  The pieces along a ladder never
overlap, so whatever is counted over them is a sum of as-of counts.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.functions.names import packed
from commitlens.operators import history
from commitlens.session import Rounds, cut

COMMIT = ["project_id", "sha"]


def by_reach(t, merges: bool | None) -> bool:
    """Whether "up to a commit" means what it reaches: as asked, else wherever parents are known."""
    return getattr(t, "commit_parents", None) is not None if merges is None else merges


def by_bytes(rows: DataFrame) -> DataFrame:
    """Rows with their commit's name as bytes, for shuffles that move it many times."""
    return rows.withColumn("sha", packed(F.col("sha")))


def _numbers(commits: DataFrame) -> DataFrame:
    """(project_id, sha, copies, id): every commit's number, in the order of projects and names.

    Rounds move numbers, not names: a name has 40 characters that don't compress.
    """
    known = commits.select(*COMMIT).dropna().groupBy(*COMMIT).agg(F.count(F.lit(1)).alias("copies"))
    return cut(known.orderBy(*COMMIT).withColumn("id", F.monotonically_increasing_id()), "numbers")


def _numbered_links(numbers: DataFrame, first: DataFrame) -> DataFrame:
    """(id, parent) of first parents.  A parent that isn't among the commits gets a number below zero."""
    lower = numbers.select("project_id", F.col("sha").alias("parent_sha"), F.col("id").alias("parent"))
    unknown = -1 - F.shiftrightunsigned(F.xxhash64("project_id", "parent_sha"), 1)
    return cut(
        first.filter("parent_sha IS NOT NULL").select(*COMMIT, "parent_sha")
        .join(numbers.select(*COMMIT, "id"), COMMIT)
        .join(lower, ["project_id", "parent_sha"], "left")
        .select("id", F.coalesce("parent", unknown).alias("parent")),
        "parents",
    )


def _followers(rows: DataFrame, first: DataFrame) -> DataFrame:
    """For each commit with children by first parent, the child with most descendants.

    Taking the heaviest child keeps the number of chains on any way down to the
    first commit within the logarithm of the history's size.  Descendants are
    counted by doubling: those less than 2k steps away are those less than k away
    and, for each commit k steps above, those less than k away from it.
    """
    rounds = Rounds("followers")
    state = rounds.put(
        rows.join(first.select("id", F.col("parent").alias("target")), "id", "left").withColumn("size", F.lit(1).cast("bigint"))
    )
    while not state.filter("target IS NOT NULL").isEmpty():
        above = state.filter("target IS NOT NULL").groupBy(F.col("target").alias("id")).agg(F.sum("size").alias("more"))
        further = state.filter("target IS NOT NULL").select(F.col("id").alias("target"), F.col("target").alias("next"))
        grown = state.join(above, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        # Finished rows have no target: they stand aside, or all of them would meet in one key.
        moved = grown.filter("target IS NOT NULL").join(further, "target", "left")
        state = rounds.put(moved.select("id", F.col("next").alias("target"), "size").unionByName(grown.filter("target IS NULL").select("id", "target", "size")))
    return first.join(state.select("id", "size"), "id").groupBy("parent").agg(F.max_by("id", F.struct("size", "id")).alias("id"))


def chains(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """(project_id, sha, chain, pos): the chain is named by the number of its lowest commit, pos 1.

    Positions come from doubling jumps down the chain.  A row leaves the loop
    when its jump lands on the end, so no join key ever has more than one row
    on either side.
    """
    numbers = _numbers(commits)
    rows = numbers.select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("id")
    follower = _followers(rows, _numbered_links(numbers, parents.filter(F.col("parent_no") == 1)))
    jumps = cut(
        rows.join(follower, "id", "left").select(
            "id", F.coalesce("parent", "id").alias("target"), F.col("parent").isNotNull().cast("bigint").alias("steps")
        )
    )
    rounds = Rounds("chains")
    ends = jumps.filter("steps = 0").select(F.col("id").alias("target"), F.lit(True).alias("at_end"))
    state = rounds.put(jumps.join(ends, "target", "left").withColumn("at_end", F.coalesce("at_end", F.lit(False))))
    while not state.filter("NOT at_end").isEmpty():
        further = state.select(
            F.col("id").alias("target"),
            F.col("target").alias("next_target"),
            F.col("steps").alias("next_steps"),
            F.col("at_end").alias("next_at_end"),
        )
        moved = (
            state.filter("NOT at_end")
            .join(further, "target")
            .select(
                "id",
                F.col("next_target").alias("target"),
                (F.col("steps") + F.col("next_steps")).alias("steps"),
                F.col("next_at_end").alias("at_end"),
            )
        )
        state = rounds.put(state.filter("at_end").unionByName(moved))
    return numbers.select(*COMMIT, "id").join(state, "id").select(*COMMIT, F.col("target").alias("chain"), (F.col("steps") + 1).alias("pos"))


def links(placed: DataFrame, parents: DataFrame) -> DataFrame:
    """(project_id, chain, pos, other, at, stands): parents in other chains than their child's.

    ``stands`` marks the link by which a chain's lowest commit follows its first parent.
    """
    upper = placed.select(*COMMIT, "chain", "pos")
    lower = placed.select("project_id", F.col("sha").alias("parent_sha"), F.col("chain").alias("other"), F.col("pos").alias("at"))
    return (
        parents.join(upper, COMMIT)
        .join(lower, ["project_id", "parent_sha"])
        .filter(F.col("chain") != F.col("other"))
        .select("project_id", "chain", "pos", "other", "at", ((F.col("parent_no") == 1) & (F.col("pos") == 1)).alias("stands"))
    )


def ladder(exits: DataFrame) -> DataFrame:
    """(project_id, chain, other, at): all places that a chain stands on, one below the other."""
    below = cut(
        exits.filter("stands").groupBy("project_id", "chain").agg(F.max(F.struct("other", "at")).alias("b")).select("project_id", "chain", "b.*")
    )
    further = below.select("project_id", F.col("chain").alias("other"), F.col("other").alias("next"), F.col("at").alias("next_at"))
    rungs = [below]
    while not rungs[-1].isEmpty():
        step = rungs[-1].drop("at").join(further, ["project_id", "other"])
        rungs.append(cut(step.select("project_id", "chain", F.col("next").alias("other"), F.col("next_at").alias("at"))))
    return reduce(DataFrame.unionByName, rungs)


def takes(exits: DataFrame, rungs: DataFrame) -> DataFrame:
    """(project_id, chain, pos, other, old, new): what the merges of a chain add to what it reached before:
    the places behind ``old`` up to ``new`` of another chain, reached from ``pos`` on.

    Rounds go from chain to chain: what a merge adds is followed through the links that lie in
    the added piece only.
    """
    key = ["project_id", "chain", "other"]
    standing = rungs.groupBy(*key).agg(F.max("at").alias("base"))
    rounds = Rounds("takes")
    found = exits.filter("NOT stands").groupBy(*key, "pos").agg(F.max("at").alias("new")).withColumn("fresh", F.lit(True))
    while True:
        placed = history.greatest_before(found, key, ["pos"], "new", "old").join(standing, key, "left")
        old = F.greatest("old", F.coalesce("base", F.lit(0)))
        known = rounds.put(placed.withColumn("old", old).filter("new > old").select(*key, "pos", "old", "new", "fresh"))
        if known.filter("fresh").isEmpty():
            break
        pieces = known.filter("fresh").select(
            "project_id", F.col("chain").alias("mine"), F.col("pos").alias("from"), F.col("other").alias("chain"), "old", "new"
        )
        onward = exits.select("project_id", "chain", "pos", F.col("other").alias("next"), "at")
        met = (
            history.within_ranges(pieces, onward, ["project_id", "chain"], "old", "new", "pos")
            .filter(F.col("mine") != F.col("next"))
            .select("project_id", F.col("mine").alias("chain"), F.col("next").alias("other"), F.col("from").alias("pos"), F.col("at").alias("new"), F.lit(True).alias("fresh"))
        )
        both = known.select(*key, "pos", "new", F.lit(False).alias("fresh")).unionByName(met)
        # A place known before is not fresh again.
        found = both.groupBy(*key, "pos").agg(F.max(F.struct("new", (~F.col("fresh")).alias("seen"))).alias("m")).select(
            *key, "pos", "m.new", (~F.col("m.seen")).alias("fresh")
        )
    # What the chains below have taken in already is no addition.
    asked = known.select(*key).distinct().join(rungs.withColumnsRenamed({"other": "below", "at": "pos"}), ["project_id", "chain"])
    asked = asked.select("project_id", F.col("below").alias("chain"), "other", "pos", F.lit(None).cast("bigint").alias("new"), F.col("chain").alias("asks"))
    both = known.select(*key, "pos", "new", F.lit(None).cast("string").alias("asks")).unionByName(asked)
    there = history.greatest_before(both.withColumn("late", F.col("asks").isNotNull()), key, ["pos", "late"], "new", "covered")
    covered = there.filter("late").groupBy("project_id", F.col("asks").alias("chain"), "other").agg(F.max("covered").alias("covered"))
    return (
        known.join(covered, key, "left")
        .withColumn("old", F.greatest("old", F.coalesce("covered", F.lit(0))))
        .filter("new > old")
        .select("project_id", "chain", "pos", "other", "old", "new")
    )


def index(placed: DataFrame, parents: DataFrame):
    """The ladder and the takes of all chains."""
    exits = cut(links(placed, parents))
    rungs = cut(ladder(exits))
    return rungs, cut(takes(exits, rungs))


class Reached:
    """What a set of requested commits reaches, ready to be joined with facts.

    ``t`` holds ``commits``, ``commit_parents`` and, where they were stored with them,
    ``commit_chains``, ``commit_ladder`` and ``commit_takes``.  ``till`` has a requested commit's
    place in its chain and all places below: what it reaches is what has entered those chains up to there.
    With ``names_packed`` the names of commits are bytes, in ``requests``, facts and results as well.
    """

    def __init__(self, t, requests: DataFrame, names_packed: bool = False):
        stored = getattr(t, "commit_chains", None)
        self.placed = cut(chains(t.commits, t.commit_parents)) if stored is None else stored
        if getattr(t, "commit_takes", None) is None:
            self.rungs, self.taken = index(self.placed, t.commit_parents)
        else:
            self.rungs, self.taken = t.commit_ladder, t.commit_takes
        if names_packed:
            self.placed = by_bytes(self.placed)
        own = requests.select(*COMMIT).distinct().join(self.placed, COMMIT).select(
            "project_id", F.col("sha").alias("till_sha"), "chain", F.col("pos").alias("till")
        )
        below = own.drop("till").join(self.rungs, ["project_id", "chain"]).select(
            "project_id", "till_sha", F.col("other").alias("chain"), F.col("at").alias("till")
        )
        self.till = own.unionByName(below)

    def with_position(self, facts: DataFrame) -> DataFrame:
        """Facts of commits with their chain; ``seq`` becomes the place in it."""
        columns = [c for c in facts.columns if c != "seq"]
        return facts.select(*columns).join(self.placed, COMMIT).withColumnRenamed("pos", "seq")

    def entered(self, facts: DataFrame) -> DataFrame:
        """Facts of commits with every chain they belong to or are taken into, and the place there."""
        return self.spread(self.with_position(facts))

    def spread(self, own: DataFrame) -> DataFrame:
        """The same for facts that have their position."""
        pieces = self.taken.select("project_id", F.col("other").alias("chain"), F.col("chain").alias("into"), "pos", "old", "new")
        taken = history.within_ranges(pieces, own, ["project_id", "chain"], "old", "new", "seq")
        return own.unionByName(
            taken.drop("chain", "seq", "old", "new").withColumnsRenamed({"into": "chain", "pos": "seq"})
        )

    def join(self, facts: DataFrame, points: DataFrame | None = None, keys=()) -> DataFrame:
        """Facts with all requested commits (``till_sha``) that reach theirs.

        ``points`` restricts the pairs to requested values of ``keys``.
        """
        till = self.till if points is None else self.till.join(points, ["project_id", "till_sha"])
        found = history.join_until(till, self.entered(facts), ["project_id", "chain", *keys])
        return found.drop("chain", "seq", "till")

    def count(self, events: DataFrame, points: DataFrame, keys, name) -> DataFrame:
        """Number of reached events of commits per point (project_id, till_sha, keys)."""
        # Without their names facts are small when written, and they are read twice.
        own = cut(self.with_position(events).select("project_id", "chain", "seq", *keys), "entered")
        return self.count_entered(self.spread(own), points, keys, name)

    def count_entered(self, entered: DataFrame, points: DataFrame, keys, name) -> DataFrame:
        """The same for events with their chains and places.

        Events and places that are asked for are sorted together once, bucket by bucket of a chain.
        """
        by_chain = ["project_id", "chain", *keys]
        last = self.placed.agg(F.max("pos")).first()[0]
        places = self.till.join(points, ["project_id", "till_sha"]).select(*by_chain, F.col("till").alias("seq"), "till_sha")
        nobody = F.lit(None).cast(points.schema["till_sha"].dataType).alias("till_sha")
        events = entered.select(*by_chain, "seq", nobody, F.lit(0).alias("_point"))
        both = events.unionByName(places.withColumn("_point", F.lit(1)))
        counted = history.running(both, by_chain, {"_n": 1 - F.col("_point").cast("bigint")}, ("seq", "_point"), last=last)
        summed = (
            counted.filter((F.col("_point") == 1) & (F.col("_n") > 0))
            .groupBy("project_id", "till_sha", *keys)
            .agg(F.sum("_n").alias(name))
        )
        return points.join(summed, ["project_id", "till_sha", *keys], "left").withColumn(
            name, F.coalesce(name, F.lit(0).cast("bigint"))
        )

    def sizes(self, name: str) -> DataFrame:
        """(project_id, till_sha, name): how many commits each requested commit reaches, itself included."""
        chain = ["project_id", "chain"]
        added = self.taken.select(*chain, F.col("pos").alias("seq"), (F.col("new") - F.col("old")).alias("n"))
        places = self.till.select(*chain, F.col("till").alias("seq")).distinct()
        sums = history.count_as_of(added, places, chain, "_n", weight="n")
        asked = self.till.withColumnRenamed("till", "seq").join(sums, [*chain, "seq"])
        return asked.groupBy("project_id", "till_sha").agg(F.sum(F.col("seq") + F.col("_n")).alias(name))
