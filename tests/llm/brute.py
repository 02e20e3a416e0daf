"""Plain versions of the operators, one document or one pair at a time."""

import collections
import hashlib
import random
import re

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(("the", "of", "and", "in")) if r.random() < 0.3 else "".join(r.choices("abcdeghilmnorstu", k=r.randint(3, 8))) for _ in range(n))


def words(text):
    return WORD.findall(text or "")


def measures(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = collections.Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if count[x] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def targets(rows, most=3.0):
    """Sizes and targets by source from (text, source), resharing round by round."""
    size = collections.Counter()
    for text, source in rows:
        size[source] += len(words(text))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(size.values()) - sum(fixed.values())
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * size[s]]
        if not over:
            return size, fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: most * size[s] for s in over}


def simhash(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """Least reachable id of every (id, fingerprint); ids may repeat or be None."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(len(prints)):
        groups[find(k)].append(k)
    out = [None] * len(prints)
    for members in groups.values():
        ids = [prints[k][0] for k in members if prints[k][0] is not None]
        for k in members:
            out[k] = min(ids) if ids else None
    return out


def removals(rows, k=13):
    """(id, n_words, n_removed, sha256) of (id, text) rows."""
    first = {}
    for doc, text in rows:
        if doc is not None:
            w = words(text)
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        if doc is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < doc:
                    gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def template(text):
    """(word as read, whether it may be a name, placeholder type or None, value) of every word."""
    from commitlens.llm.decontaminate import NUMBERS, STARTERS, UNITS

    numbers, units, starters = set(NUMBERS.split()), set(UNITS.split()), set(STARTERS.lower().split())
    t = regex.sub(r"(?<=\d)[.,](?=\d)", "", text or "")
    t = regex.sub(r"(?<=[0-9])(?=\p{L})", " ", t)
    out = []
    for m in regex.finditer(r"[\p{L}\p{N}]+", t):
        word, low = m[0], m[0].lower()
        capital = regex.match(r"\p{Lu}\p{Ll}+", word)
        before = out[-1] if out else None
        number = "0" <= low[0] <= "9" or low in numbers
        if capital and regex.search(r"[\p{Ll},;] $", t[: m.start()]):
            out.append((low, False, "p", low))
        elif capital:
            out.append((low, low not in starters, None, low))
        elif number:
            out.append((low, False, "n", low))
        elif low in units and before and before[2] == "n":
            out.append((low, False, "u", low))
        else:
            out.append((low, False, None, low))
    return out


def leaked(docs, items, size=8, least=6):
    """(doc, item, windows, windows of the item, reworded) of (id, text) rows, alignment by alignment."""

    def keys(words, i, names):
        return tuple("\1" + (w[2] or "p") if w[2] or (names and w[1]) else w[0] for w in words[i : i + size])

    def slots(words, i, names):
        return [(w[2] or "p", w[3]) for w in words[i : i + size] if w[2] or (names and w[1])]

    out = set()
    for doc, text in set(docs):
        d = template(text)
        for item, item_text in set(items):
            b = template(item_text)
            n = len(b) - size + 1
            if n < 1 or len(d) < size:
                continue
            counted = {}
            for names in (False, True):
                for shift in range(-n, len(d)):
                    met = {}
                    for i in range(n):
                        if not 0 <= i + shift <= len(d) - size:
                            continue
                        ways = [(x, y) for x in (False, True) for y in (False, True) if names or not (x or y)]
                        # A window read with names has a name in it; else the plain reading stands for it.
                        ways = [(x, y) for x, y in ways if (not x or any(w[1] for w in d[i + shift : i + shift + size])) and (not y or any(w[1] for w in b[i : i + size]))]
                        pairs = [
                            list(zip(slots(b, i, y), slots(d, i + shift, x))) for x, y in ways if keys(d, i + shift, x) == keys(b, i, y)
                        ]
                        if pairs:
                            met[i] = {p for way in pairs for p in way}
                    votes = collections.Counter(p for found in met.values() for p in found)
                    meant = {}
                    for (ours, theirs), c in votes.items():
                        meant[ours] = min(meant.get(ours, (1,)), (-c, ours != theirs, theirs))
                    for i, found in met.items():
                        verbatim = all(x == y for x, y in found)
                        if verbatim or all(meant[x][2] == y for x, y in found):
                            counted[i] = min(counted.get(i, True), not verbatim)
            if counted and len(counted) >= min(least, -(-n // 2)):
                out.add((doc, item, len(counted), n, max(counted.values())))
    return out
