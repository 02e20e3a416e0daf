"""BPE encoding and decoding by a pair occurrence index.

The distinct pieces of a slice of texts are laid end to end as one list of symbols.  An index
maps the rank of every adjacent pair to all its positions.  Active ranks are applied in
ascending order, each at all its positions from left to right; a merge changes two neighbouring
pairs, whose lists are updated, so the work is that of the merges made and not of the ranks
there are.  If a merge brings up a pair of lower rank, the rest of that piece waits
until the lower rank has been applied, as it does when pieces are encoded one by one.

Vocabularies are ``tokenizers`` files of one form (``Vocabulary`` refuses others): BPE over the
bytes of pieces with an end-of-word suffix, special tokens met in the raw text, texts without case.
Unicode's composition, case and classes are those of that library; merging and decoding are here.
Nothing is trained.  The file is read on the driver; its merges travel with the task (a few MB).

A null text is an empty one: no tokens, an empty decoded text.  Texts are encoded whole, however
long; memory follows ``words.CHUNK`` bytes of text or the longest text, plus what a task remembers of ``CACHE``
chunks and pieces.  Repeated rows give repeated results, an empty table an empty one.  Other columns
are left behind (``carry`` keeps some), so their names can't clash.
"""

import json
from collections import defaultdict
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm import words as W

#: White-space separated chunks, and pieces, whose tokens a task keeps.
CACHE = 1 << 18
#: New pieces that are indexed at a time.
PIECES = 1 << 12
#: Symbols are joined to pairs as left * PAIR + right.
PAIR = 1 << 32

#: The normaliser of a supported file.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_letters():
    """The letter that stands for each byte in a vocabulary: itself if it is printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printable))
    return [letters[b] for b in range(256)]


class Vocabulary:
    """The tokens, merges and patterns of a tokenizer file."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, (split, level) = config["model"], config["pre_tokenizer"]["pretokenizers"]
        plain = all(not model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        special = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in config["added_tokens"])
        form = [model["type"], config["normalizer"]["normalizers"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]]
        if not (plain and special and form == ["BPE", NORMALIZERS, "Removed", True, "ByteLevel", False, False] and config["decoder"] is None):
            raise ValueError(f"{path}: not a word-level byte BPE of the supported form")
        ids = {**model["vocab"], **{t["content"]: t["id"] for t in config["added_tokens"]}}
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.pattern = split["pattern"]["Regex"]
        self.tokens = [""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)


class Merger:
    """Applies the merges of a vocabulary to many pieces at once."""

    def __init__(self, vocabulary):
        v = self.vocabulary = vocabulary
        keys = v.left * PAIR + v.right
        self.ranks = dict(zip(keys.tolist(), range(len(keys))))
        self.merges = list(zip(v.left.tolist(), v.right.tolist(), v.made.tolist()))
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def tokens(self, pieces):
        """The token ids of every piece (bytes, none empty): one array, and where each piece ends in it."""
        v = self.vocabulary
        ends = np.cumsum([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = v.inner[data]
        symbols[ends - 1] = v.last[data[ends - 1]]
        symbols = np.array(self._apply(symbols, ends), np.int64)
        alive = symbols >= 0
        return symbols[alive], np.cumsum(alive)[ends - 1]

    def _index(self, symbols, ends):
        """The positions of every pair that has a rank, by rank."""
        found = symbols[:-1] * PAIR + symbols[1:]
        place = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        known = self.keys[place] == found
        known[ends[:-1] - 1] = False
        at = np.flatnonzero(known)
        rank = self.order[place[at]]
        by_rank = np.argsort(rank, kind="stable")
        at, rank = at[by_rank], rank[by_rank]
        new = np.flatnonzero(np.diff(rank, prepend=-1))
        where = defaultdict(list)
        for r, a, b in zip(rank[new].tolist(), new.tolist(), [*new[1:].tolist(), len(at)]):
            where[r] = at[a:b].tolist()
        return where

    def _apply(self, symbols, ends):
        """The symbols after all merges; a symbol that went into its left neighbour is -1."""
        n = len(symbols)
        if n < 2 or not len(self.keys):
            return symbols
        where = self._index(symbols, ends)
        following, previous = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        previous[np.append(0, ends[:-1])] = -1
        piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)).tolist()
        symbols, following, previous = symbols.tolist(), following.tolist(), previous.tolist()
        active = list(where)
        heapify(active)
        ranks = self.ranks
        while active:
            rank = heappop(active)
            if rank not in where:
                continue
            a, b, made = self.merges[rank]
            waiting, later = set(), []
            for p in sorted(where.pop(rank)):
                q = following[p]
                if symbols[p] != a or q < 0 or symbols[q] != b:
                    continue
                if waiting and piece[p] in waiting:
                    later.append(p)
                    continue
                r, o = following[q], previous[p]
                symbols[p], symbols[q], following[p] = made, -1, r
                if r >= 0:
                    previous[r] = p
                    new = ranks.get(made * PAIR + symbols[r])
                    if new is not None:
                        if new not in where:
                            heappush(active, new)
                        where[new].append(p)
                        if new < rank:
                            waiting.add(piece[p])
                if o >= 0:
                    new = ranks.get(symbols[o] * PAIR + made)
                    if new is not None:
                        if new not in where:
                            heappush(active, new)
                        where[new].append(o)
                        if new < rank:
                            waiting.add(piece[p])
            if later:
                if rank not in where:
                    heappush(active, rank)
                where[rank] += later
        return symbols


class Encoder:
    """Texts to token ids; remembers the chunks it has met."""

    def __init__(self, vocabulary):
        from tokenizers import Regex, normalizers, pre_tokenizers

        v = self.vocabulary = vocabulary
        self.merger = Merger(v)
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\\s+"), " "), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(v.pattern), "removed", invert=True)
        self.pieces_of = regex.compile(v.pattern).findall
        self.odd = regex.compile("[\x1c-\x1f]").search
        by_length = sorted(v.special, key=lambda t: (-len(t), t))
        self.special = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.packed, self.of_piece = {}, {}

    def chunks(self, text):
        """A text's chunks between white space; special tokens are their ids instead."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.vocabulary.special[part])
            elif part.isascii() and not self.odd(part):
                out += part.lower().split()
            else:
                out += self.normalizer.normalize_str(part).split(" ")
        return out

    def pieces(self, chunk):
        if chunk.isascii():
            return self.pieces_of(chunk)
        return [p for p, _ in self.splitter.pre_tokenize_str(chunk)]

    def learn(self, chunks):
        """Put the tokens of chunks into the cache."""
        cut = {c: self.pieces(c) if isinstance(c, str) else [] for c in chunks}
        of_piece = self.of_piece
        new = list(set(chain.from_iterable(cut.values())).difference(of_piece))
        for start in range(0, len(new), PIECES):
            part = new[start : start + PIECES]
            ids, ends = self.merger.tokens([p.encode() for p in part])
            ids = ids.astype("<u4").tobytes()
            ends = (4 * ends).tolist()
            of_piece.update(zip(part, [ids[a:b] for a, b in zip([0, *ends], ends)]))
        for c, pieces in cut.items():
            if len(pieces) == 1:
                self.packed[c] = of_piece[pieces[0]]
            else:
                self.packed[c] = b"".join([of_piece[p] for p in pieces]) if isinstance(c, str) else c.to_bytes(4, "little")

    def encode(self, texts):
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.chunks(t) for t in texts]
        for cache in (self.packed, self.of_piece):
            if len(cache) > CACHE:
                cache.clear()
        self.learn(set(chain.from_iterable(cut)).difference(self.packed))
        get = self.packed.__getitem__
        return [b"".join(map(get, c)) for c in cut]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", carry=()) -> DataFrame:
    """(key, carried columns, n_tokens, ids) of every text by the vocabulary at ``path``.

    ``ids`` is binary, a little-endian unsigned 32-bit integer per token, as token shards store them.
    """
    vocabulary = Vocabulary(path)

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in W.slices(texts):
                ids = encoder.encode([t or "" for t in texts.slice(start, stop - start).to_pylist()])
                kept = [batch.column(i).slice(start, stop - start) for i in range(batch.num_columns - 1)]
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(kept + made, names=out.names)

    out = W.schema("n_tokens bigint, ids binary", docs.select(key, *carry).schema)
    return docs.select(key, *carry, F.col(text).cast("string")).mapInArrow(run, out)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with a column ``decoded``: the tokens' own strings joined by one space; a null stays null.

    An id that the vocabulary doesn't have is an error.
    """
    names = Vocabulary(path).tokens
    n = len(tokens.columns)

    def run(batches):
        strings = pa.array(names, pa.large_string())
        for batch in batches:
            column = batch.column(n)
            for start, stop in W.slices(column):
                rows = batch.slice(start, stop - start)
                packed = rows.column(n).to_pylist()
                flat = np.frombuffer(b"".join(x or b"" for x in packed), "<u4")
                ends = np.cumsum([0, *(len(x or b"") // 4 for x in packed)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings.take(pa.array(flat, pa.uint32())))
                texts = pc.if_else(pc.is_valid(rows.column(n)), pc.binary_join(lists, pa.scalar(" ", pa.large_string())), pa.scalar(None, pa.large_string()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:n], texts.cast(pa.string())], names=out.names)

    out = W.schema("decoded string", tokens.schema)
    return tokens.select("*", F.col(ids).alias("_packed")).mapInArrow(run, out)
