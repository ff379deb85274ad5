"""Fixtures that every operator must survive, and plain versions of what they compute."""

import random

from pyspark.sql import types as T

# Columns whose names clash with what operators add or use inside.
CLASH = ["score", "predicted", "fingerprint", "ids", "n_tokens", "n_lines", "kept_text", "key", "n", "h", "gid", "bucket"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASH]
)


def frame(spark, rows):
    """rows of (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or ""), *["x"] * len(CLASH)) for k, (i, t) in enumerate(rows)], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}é{r.randrange(9)}" for _ in range(n))


def edge_rows():
    shared = prose(99, 60)
    line = "A Shared line of more than twenty characters"
    a = prose(1, 120)
    b = a.split()
    b[50] = "changed"
    return [
        (1, a), (2, a), (3, " ".join(b)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two three"),
        (9, prose(2, 80) + " " + shared), (10, shared + " " + prose(3, 90)), (11, f"{line}\nx\n{line}"), (12, f"  {line.upper()}\t\ny"), (13, f"{line}"), (14, f"{line}\n{line}"),
        (15, "be " * 50), (16, prose(4, 4000)), (17, "日本語 ünï 😀 <|endoftext|> don't  x"), (18, "y" * 3000), (19, prose(5, 35)), (20, prose(5, 35)), (None, "no id here at all"), (21, prose(6, 34)), (22, prose(6, 34)),
    ]


WHITE = " \t\n\v\f\r"


def words(text):
    out, cur = [], ""
    for c in text or "":
        if c in WHITE:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur] if cur else out


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text):
    w = words(low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """doc position to the least position reachable by links."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return sets, comp


def dedup_lines(rows, least_docs=3, least_chars=20):
    held = {}
    for i, t in rows:
        for k in {low(x.strip(WHITE)) for x in (t or "").split("\n")}:
            if len(k) >= least_chars:
                held.setdefault(k, []).append(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(1 << 63) if i is None else i
        kept = [x for x in lines if not (len(held.get(k := low(x.strip(WHITE)), [])) >= least_docs and max(held[k]) != own)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def remove_repeats(rows, size=35):
    seen = {}
    for _, t in rows:
        w = words(t)
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - size + 1):
            if seen[tuple(w[s : s + size])] > 1:
                gone |= set(range(s, s + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)
