"""Roles of unlabelled chat transcripts by a hidden Markov model over lines.

A state is a role and whether a line begins a turn.  A line is seen as its speaker marker, if
any, and its shape.  Emissions and transitions are counted on transcripts with known roles
(at most ``SAMPLE`` of them, a documented bound), Viterbi finds the likeliest states of a
transcript, and turns are rendered in one canonical form.

A long conversation is many pieces of ``PIECE`` turns.  Viterbi runs over all of them as over one text: a
piece's best scores from every state to every state are a matrix, matrices are multiplied (max for plus, plus
for times) in groups of ``FAN``, groups of groups and so on, and what lies before and behind a piece goes into
its own search.  So where a text is cut has no influence on its states, and no group is large.

A null or empty transcript has no turns.  Lines are separated by \\n; blank lines belong to the
turn they stand in and are trimmed at its ends.  A transcript with null id keeps it; repeated
rows give repeated results, an empty table an empty one.  Ties: of equally likely states the first counts; turns
of one number are taken in an order by hash, and pieces are cut by place, so that null ids and
repeated turns fill no piece.  Only the named columns are read, so other columns' names can't clash.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import words as W
from commitlens.operators import history
from commitlens.session import cut

SAMPLE = 3000
PIECE = 64
FAN = 512
ROLES = ("system", "user", "assistant")
STATES = [(r, begin) for r in ROLES for begin in (True, False)]
#: Words that name a speaker, and the role they usually stand for.
SPEAKERS = {
    **dict.fromkeys("user human customer question q prompter me you person client".split(), "user"),
    **dict.fromkeys("assistant ai bot gpt model answer a response chatbot agent".split(), "assistant"),
    **dict.fromkeys("system sys context instruction instructions".split(), "system"),
}
_MARKER = re.compile(
    r"^\s*(?:(?:#{1,6}\s*|\*\*|\[|<\|?|>\s*|\()?\s*)(" + "|".join(sorted(SPEAKERS, key=len, reverse=True)) + r")(?:\s*(?:\*\*:?|\|?>|\]:?|\)|:))\s*",
    re.I,
)
MARKS = ("none", *ROLES)
SHAPES = ("blank", "asks", "list", "short", "middle", "long")


def look(line):
    """(marker, shape, text without the marker) of a line."""
    m = _MARKER.match(line)
    mark = SPEAKERS[m[1].lower()] if m else "none"
    text = line[m.end() :] if m else line
    bare = text.strip()
    if not bare:
        shape = "blank"
    elif bare.endswith("?"):
        shape = "asks"
    elif bare[0] in "-*+#|`" or re.match(r"\d+[.)]\s", bare):
        shape = "list"
    else:
        shape = SHAPES[3 + (len(bare) > 60) + (len(bare) > 200)]
    return MARKS.index(mark), SHAPES.index(shape), text


class Model:
    """Log probabilities of the first state, of transitions, and of markers and shapes by state."""

    def __init__(self, transcripts):
        """``transcripts`` are lists of (role, text) turns with their lines as written."""
        n = len(STATES)
        first, step = np.full(n, 0.5), np.full((n, n), 0.1)
        mark, shape = np.full((n, len(MARKS)), 0.2), np.full((n, len(SHAPES)), 0.5)
        # Without any example: markers usually tell the truth, and turns alternate.
        for i, (role, begin) in enumerate(STATES):
            mark[i, MARKS.index(role)] += 2 * begin
            mark[i, 0] += 2
            for j, (other, new) in enumerate(STATES):
                step[i, j] += 2 * (other == role and not new) + (other != role and new)
                # A turn goes on in its own role only.
                if not new and other != role:
                    step[i, j] = 1e-12
        first[1::2] = 1e-12
        for turns in transcripts:
            before = None
            for role, text in turns:
                if role not in ROLES:
                    continue
                for k, line in enumerate(text.split("\n")):
                    state = 2 * ROLES.index(role) + (k > 0)
                    m, s, _ = look(line)
                    mark[state, m] += 1
                    shape[state, s] += 1
                    if before is None:
                        first[state] += 1
                    else:
                        step[before, state] += 1
                    before = state
        self.first = np.log(first / first.sum())
        self.step = np.log(step / step.sum(axis=1, keepdims=True))
        self.mark = np.log(mark / mark.sum(axis=1, keepdims=True))
        self.shape = np.log(shape / shape.sum(axis=1, keepdims=True))

    def _emission(self, seen):
        return self.mark[:, [m for m, _, *_ in seen]] + self.shape[:, [s for _, s, *_ in seen]]

    def start(self):
        """Scores of the states before the first line: none of them, but the state of not having begun."""
        return np.append(np.full(len(STATES), -np.inf), 0.0)

    def matrix(self, transcript):
        """The best score of a piece's lines from every state before it, or from not having begun, to every state at its end."""
        steps = np.vstack([self.step, self.first])
        best = steps
        for t, e in enumerate(self._emission([look(line) for line in transcript.split("\n")]).T):
            best = (times(best, self.step) if t else best) + e
        return np.hstack([best, np.full((len(STATES) + 1, 1), -np.inf)])

    def states(self, seen, before=None, after=None):
        """The likeliest states of lines seen as (marker, shape), by Viterbi, given the best scores
        of states ``before`` them (with that of not having begun) and of what comes ``after`` them."""
        emission = self._emission(seen)
        best = self.first if before is None else (np.asarray(before)[:, None] + np.vstack([self.step, self.first])).max(axis=0)
        best = best + emission[:, 0]
        back = np.zeros((len(seen), len(STATES)), dtype=np.int8)
        for t in range(1, len(seen)):
            score = best[:, None] + self.step
            back[t] = score.argmax(axis=0)
            best = score.max(axis=0) + emission[:, t]
        path = [int((best if after is None else best + np.asarray(after)[: len(STATES)]).argmax())]
        for t in range(len(seen) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]

    def turns(self, transcript, before=None, after=None):
        """(role, text) of every turn of a transcript, or of a piece between others."""
        if not transcript:
            return []
        seen = [look(line) for line in transcript.split("\n")]
        out = []
        for state, (_, _, text) in zip(self.states(seen, before, after), seen):
            role, begin = STATES[state]
            if begin or not out:
                out.append((role, [text]))
            else:
                out[-1][1].append(text)
        return [(role, "\n".join(lines).strip()) for role, lines in out]


def render(turns):
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def times(a, b):
    """The product of matrices with max for plus and plus for times."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _square(values):
    n = len(STATES) + 1
    return np.asarray(values, float).reshape(n, n)


def surroundings(transcripts: DataFrame, model: Model, piece: str) -> DataFrame:
    """(id, place, before, after) of the pieces of ids that have several: scores of the states around each."""
    counts = transcripts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("i"))
    long = transcripts.select("id", F.col(piece).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    long = long.join(counts, long["id"].eqNullSafe(counts["i"]), "left_semi")

    def measure(part):
        rows = [model.matrix(t).ravel().tolist() for t in part["text"].to_pylist()]
        return {"id": part["id"], "place": part["place"], "m": pa.array(rows, pa.list_(pa.float64()))}

    level = cut(W.map_texts(long, ["id", "place", "text"], "text", W.schema("id bigint, place bigint, m array<double>"), measure), "matrices")
    levels = [level]
    while (level.agg(F.max("place")).first()[0] or 0) > 0:

        def product(key, table):
            ordered = table.sort_by("place").column("m").to_pylist()
            whole = _square(ordered[0])
            for m in ordered[1:]:
                whole = times(whole, _square(m))
            return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "place": pa.array([key[1].as_py()], pa.int64()), "m": [whole.ravel().tolist()]})

        group = level.withColumn("block", F.floor(F.col("place") / FAN).cast("bigint"))
        level = cut(group.groupBy("id", "block").applyInArrow(product, "id bigint, place bigint, m array<double>"), "products")
        levels.append(level)
    start, none = model.start().tolist(), [0.0] * (len(STATES) + 1)
    literal = lambda values: F.array(*[F.lit(float(v)) for v in values])
    around = levels[-1].select("id", "place", literal(start).alias("before"), literal(none).alias("after"))

    def spread(key, table):
        rows = table.sort_by("place")
        squares = [_square(m) for m in rows.column("m").to_pylist()]
        before, after = [np.asarray(rows.column("before")[0].as_py())], [np.asarray(rows.column("after")[0].as_py())]
        for m in squares[:-1]:
            before.append((before[-1][:, None] + m).max(axis=0))
        for m in squares[:0:-1]:
            after.append((m + after[-1][None, :]).max(axis=1))
        lists = lambda vectors: pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))
        return pa.table({"id": rows.column("id"), "place": rows.column("place"), "before": lists(before), "after": lists(after[::-1])})

    for level in levels[-2::-1]:
        inner = level.withColumn("block", F.floor(F.col("place") / FAN).cast("bigint"))
        outer = around.select(F.col("id").alias("i"), F.col("place").alias("b"), "before", "after")
        both = inner.join(outer, inner["id"].eqNullSafe(outer["i"]) & (inner["block"] == outer["b"])).drop("i", "b")
        around = cut(both.groupBy("id", "block").applyInArrow(spread, "id bigint, place bigint, before array<double>, after array<double>"), "around")
    return around


def parse(transcripts: DataFrame, model: Model, keep=(), piece: str | None = None) -> DataFrame:
    """(id, roles, texts, rendered) of every row (id, text), and the ``keep`` columns.

    With ``piece`` the rows of an id are pieces of one transcript, numbered 0, 1, 2, ... by that column.
    """
    columns = ["id", "text", *keep]
    kinds = dict(transcripts.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in ("id", *keep))
    if piece is not None:
        around = surroundings(transcripts, model, piece).select(F.col("id").alias("_id"), "place", "before", "after")
        same = transcripts["id"].eqNullSafe(around["_id"]) & (transcripts[piece] == around["place"])
        transcripts = transcripts.join(around, same, "left").drop("_id", "place")
        columns += ["before", "after"]

    def measure(part):
        edges = (part.pop("before").to_pylist(), part.pop("after").to_pylist()) if piece is not None else ([None] * len(part["text"]),) * 2
        found = [model.turns(t, *e) for t, *e in zip(part["text"].to_pylist(), *edges)]
        return {
            **part,
            "roles": pa.array([[r for r, _ in t] for t in found], pa.list_(pa.string())),
            "texts": pa.array([[x for _, x in t] for t in found], pa.list_(pa.string())),
            "rendered": pa.array([render(t) for t in found], pa.string()),
        }

    return W.map_texts(
        transcripts, columns, "text", W.schema(f"{fields}, roles array<string>, texts array<string>, rendered string"), measure
    )


#: How a transcript may name its speakers; the last one names none.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instruction: ", "user": "### Human: ", "assistant": "### Assistant: "},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
    {"system": "<|system|> ", "user": "<|user|> ", "assistant": "<|assistant|> "},
    {"system": "[System] ", "user": "**User:** ", "assistant": "**AI:** "},
)


def transcripts(conversations: DataFrame) -> DataFrame:
    """(id, piece, text, roles, written) of conversations (conv_id, turn, role, text): their turns in
    one text, in one of STYLES per conversation, with every fifth marker missing.

    Equal rows count once, null texts are empty, and unknown roles are written as users'.  A
    piece holds ``PIECE`` turns, so that a long conversation is many pieces; rows of a null id are one conversation.
    """
    turn = F.coalesce(F.col("turn"), F.lit(0)).cast("bigint")
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    marks = F.lit("")
    style = F.pmod(F.xxhash64("id"), F.lit(len(STYLES)))
    for k, names in enumerate(STYLES):
        for r, mark in names.items():
            marks = F.when((style == k) & (F.col("role") == r), F.lit(mark)).otherwise(marks)
    bare = F.pmod(F.xxhash64("id", "turn"), F.lit(5)) == 0
    rows = (
        conversations.select(F.col("conv_id").cast("bigint").alias("id"), turn.alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("line", F.concat(F.when(bare, F.lit("")).otherwise(marks), F.col("text")))
        .withColumn("talk", F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id")))
        .withColumn("tie", F.xxhash64("role", "line"))
    )
    # A turn's number says roughly where it stands; of turns with one number, so does the head of their hash.
    near = F.struct(F.col("turn"), F.shiftright("tie", 52).alias("head"))
    placed = history.positions(rows, ["talk"], [F.floor(F.col("turn") / 4096), near], ["tie", "role", "line"], "nth")
    placed = placed.withColumn("piece", F.floor((F.col("nth") - 1) / PIECE).cast("bigint"))
    grouped = placed.groupBy("id", "piece").agg(F.sort_array(F.collect_list(F.struct("nth", "role", "line"))).alias("t"))
    return grouped.select("id", "piece", F.array_join("t.line", "\n").alias("text"), F.col("t.role").alias("roles_known"), F.col("t.line").alias("lines"))


def fit(known: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (roles_known, lines): about ``sample`` of them by hash."""
    total = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("id", "piece"), F.lit(1 << 20)) < int(min(1.0, sample / max(total, 1)) * (1 << 20)))
    rows = chosen.select("id", "piece", "roles_known", "lines").collect()
    rows.sort(key=lambda r: (r.id is None, r.id or 0, r.piece))
    return Model([list(zip(r.roles_known, r.lines)) for r in rows])
