"""Secret scan: fixed patterns, and a battery of randomness tests under length-aware false-discovery control."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import joined_blocks, materialise, n_parts, part_vectors, sum_blocks, unused

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
HINT = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Letters in the order of their frequency in text, so that cells of an alphabet part frequent ones from rare ones.
LOWER, DIGITS = "etaoinsrhldcumfpgwybvkxjqz", "0123456789"
LETTERS = LOWER.upper()
#: Encodings from the narrowest alphabet to the widest; the first that holds all characters is inferred.
ENCODINGS = (
    ("digits", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("base26", LOWER), ("BASE26", LETTERS), ("base32", LETTERS + "234567"), ("BASE36", LETTERS + DIGITS),
    ("base36", LOWER + DIGITS), ("base62", LOWER + LETTERS + DIGITS), ("base64", LOWER + LETTERS + DIGITS + "+/"), ("base64url", LOWER + LETTERS + DIGITS + "-_"), ("any", LOWER + LETTERS + DIGITS + "+/-_"),
)
ALPHABETS = tuple({c: i for i, c in enumerate(x)} for _, x in ENCODINGS)
#: Bits that a candidate has at least, cells of the alphabet, lengths that null strings are drawn for, and how many of each.
LEAST_BITS, CELLS, LENGTHS, DRAWS = 64, 5, (16, 18, 20, 22, 24, 28, 32, 40, 48, 64, 96, 128), 5000
#: Characters whose neighbours are counted; all others are one more.
COUNTED = LETTERS + LOWER + DIGITS + "+/-_="
STATES = len(COUNTED) + 1
PLACE = np.full(256, STATES - 1, np.int64)
PLACE[list(COUNTED.encode())] = np.arange(STATES - 1)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared for an even df."""
    term = total = math.exp(-x / 2)
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return min(1.0, total)


def randomness(s: str) -> tuple[int, int, float] | None:
    """(place of the encoding, length, p) of a string, or None if it is no candidate.

    p is the chance that uniformly random characters of the inferred encoding look at least this
    regular: chi-squared over cells of the alphabet, Wald-Wolfowitz runs about the middle, and lag-one
    serial correlation, joined by Fisher's method. Structured strings have a small one.
    """
    body = s.rstrip("=").strip("-_/+")
    n = len(body)
    if n < LENGTHS[0]:
        return None
    encoding = next((k for k, a in enumerate(ALPHABETS) if all(c in a for c in body)), None)
    if encoding is None or n * math.log2(len(ALPHABETS[encoding])) < LEAST_BITS:
        return None
    place = ALPHABETS[encoding]
    m, v = len(place), [place[c] for c in body]
    seen, share = [0] * CELLS, [0] * CELLS
    for x in v:
        seen[x * CELLS // m] += 1
    for i in range(m):
        share[i * CELLS // m] += 1
    chi = chi2_tail(sum((o - n * w / m) ** 2 / (n * w / m) for o, w in zip(seen, share, strict=True)), CELLS - 1)
    high = [2 * x >= m for x in v]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * var)) if var > 0 else 1e-12
    mid = sum(v) / n
    spread = sum((x - mid) ** 2 for x in v)
    r = sum((x - mid) * (y - mid) for x, y in zip(v, v[1:], strict=False)) / spread if spread else 1.0
    p_serial = math.erfc(abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    return encoding, n, chi2_tail(-2 * sum(math.log(max(p, 1e-12)) for p in (chi, p_runs, p_serial)), 6)


def length_class(n: int) -> int:
    """Place of the longest of LENGTHS that is no longer: the shorter string has less power to show structure."""
    return sum(n >= x for x in LENGTHS) - 1


def text_like(encoding: int, neighbours: np.ndarray, rng: np.random.Generator, n: int, draws: int) -> list[str]:
    """Structured strings of an encoding: words of the corpus's own letter pairs, run together.

    Words end as often as they do in the corpus. Each is all capitals, all lower case or digits, in
    proportion to the characters that the encoding has of these; where it has both cases, words are in
    lower case with a capital first.
    """
    alphabet = ENCODINGS[encoding][1]
    m = len(alphabet)
    fold = lambda c: COUNTED.index(c.lower())
    counts = neighbours.copy()
    upper, lower = np.arange(26), np.arange(26, 52)
    counts[lower] += counts[upper]
    counts[:, lower] += counts[:, upper]
    kind = np.array([0 if c in LETTERS else 1 if c in LOWER else 2 if c in DIGITS else 3 for c in alphabet])
    at = np.array([fold(c) for c in alphabet])
    step = (counts[np.ix_(at, at)] + 0.1) * (kind[:, None] == kind[None, :])
    begin = np.zeros(m)
    for k in np.unique(kind):
        own = kind == k
        first = counts[STATES - 1, at[own]] + 0.1
        begin[own] = own.mean() * first / first.sum()
    ends = np.clip((counts[at, STATES - 1] + 1) / (counts[at].sum(1) + 2), 0.02, 0.5)
    move, start = np.cumsum(step / step.sum(1, keepdims=True), axis=1), np.cumsum(begin)[None, :]
    pick = lambda table, u: np.minimum((table < u[:, None]).sum(1), m - 1)
    state, first = pick(start, rng.random(draws)), np.ones(draws, bool)
    swap = np.array([alphabet.find(c.upper()) if c in LOWER else alphabet.find(c.lower()) if c in LETTERS else k for k, c in enumerate(alphabet)])
    mixed, out = {0, 1} <= set(kind.tolist()), []
    for _ in range(n):
        out.append(np.where((kind[state] == np.where(first, 1, 0)) & mixed, swap[state], state))
        first = rng.random(draws) < ends[state]
        state = np.where(first, pick(start, rng.random(draws)), pick(move[state], rng.random(draws)))
    return ["".join(x) for x in np.array(list(alphabet))[np.array(out).T]]


def fisher(values: np.ndarray, m: int) -> np.ndarray:
    """``randomness`` of many strings (rows of places in an alphabet of m) of one length."""
    n = values.shape[1]
    tail = lambda x: np.exp(-x / 2) * (1 + x / 2)
    share = np.bincount(np.arange(m) * CELLS // m, minlength=CELLS)
    cell = values * CELLS // m
    chi = tail(sum(((cell == c).sum(1) - n * w / m) ** 2 / (n * w / m) for c, w in enumerate(share)))
    high = 2 * values >= m
    a = high.sum(1)
    mean = 2 * a * (n - a) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    erfc = np.vectorize(math.erfc, otypes=[float])
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    p_runs = np.where(var > 0, erfc(np.abs(runs - mean) / np.sqrt(2 * np.where(var > 0, var, 1))), 1e-12)
    off = values - values.mean(1, keepdims=True)
    spread = (off**2).sum(1)
    r = np.where(spread > 0, (off[:, 1:] * off[:, :-1]).sum(1) / np.where(spread > 0, spread, 1), 1.0)
    p_serial = erfc(np.abs(r + 1 / n) * math.sqrt(n) / math.sqrt(2))
    x = -2 * sum(np.log(np.maximum(p, 1e-12)) for p in (chi, p_runs, p_serial))
    return np.minimum(1, np.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2))


def null_tables(encodings: list[int], neighbours: np.ndarray, seed: int) -> dict[int, np.ndarray]:
    """For each encoding and length class, in descending order, how random structured strings of it look."""
    out = {}
    for encoding in encodings:
        place = ALPHABETS[encoding]
        strings = text_like(encoding, neighbours, np.random.default_rng([seed, encoding]), LENGTHS[-1], DRAWS)
        values = np.array([[place[c] for c in s] for s in strings], np.int64)
        for k, n in enumerate(LENGTHS):
            out[encoding * len(LENGTHS) + k] = -np.sort(-fisher(values[:, :n], len(place)))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kind by its place in KINDS."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, end, class, p) of runs that the tests can judge and no base span touches; class is of encoding and length."""
    out = []
    for m in RUN.finditer(text):
        if (found := randomness(m[0])) and not any(s < m.end() and m.start() < e for s, _, e in base):
            out.append((m.start(), m.end(), found[0] * len(LENGTHS) + length_class(found[1]), found[2]))
    return out


SPANS, CANDS = "array<struct<start:int,kind:int,end:int>>", "array<struct<start:int,end:int,class:int,p:double>>"


def scanned(docs: DataFrame, names: tuple[str, str, str, str, str], keep: list[str]) -> DataFrame:
    """One scan of every whole text: the columns ``keep`` with spans and candidates, and rows that sum, for each task,
    which characters stand beside each other in all its texts (block, part and vector under the last three names)."""
    base, cand, block, part, vector = names
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    cands = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.int32()), ("p", pa.float64())]))
    given = docs.select(*(docs[f"`{c}`"] for c in keep), docs["text"].cast("string").alias(vector))
    out = StructType([StructField(f.name, f.dataType) for f in given.schema][:-1])
    for name, kind in ((base, SPANS), (cand, CANDS), (block, "int"), (part, "long"), (vector, "binary")):
        out = out.add(name, StructType.fromDDL(f"x {kind}")["x"].dataType)

    def scan(batches):
        from pyspark import TaskContext

        total, types = np.zeros(STATES * STATES), None
        for batch in batches:
            texts, own = batch.column(batch.num_columns - 1), batch.columns[:-1]
            types = [c.type for c in own]
            found, seen = [], []
            for k in range(len(texts)):
                text = texts[k].as_py() or ""
                spans_ = base_spans(text)
                found.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in spans_])
                seen.append([dict(zip(("start", "end", "class", "p"), x, strict=True)) for x in candidates(text, spans_)])
                plain = RUN.sub(" ", text) if spans_ or seen[-1] else text  # what may be secret says nothing of text
                at = PLACE[np.frombuffer(plain.encode("utf-8", "surrogatepass"), np.uint8)]
                total += np.bincount(at[:-1] * STATES + at[1:], minlength=len(total))
            n = batch.num_rows
            yield pa.record_batch([*own, pa.array(found, spans), pa.array(seen, cands), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=out.names)
        if types is not None:
            for b in part_vectors(total, TaskContext.get().partitionId()):
                yield pa.record_batch([*(pa.nulls(b.num_rows, t) for t in types), pa.nulls(b.num_rows, spans), pa.nulls(b.num_rows, cands), *b.columns], names=out.names)

    return materialise(given.mapInArrow(scan, out), "secrets")


def cutoffs(scan: DataFrame, names: tuple[str, str, str, str, str], rate: float, seed: int) -> dict[int, float]:
    """For each class of candidates, the p above which a string is called random.

    Null hypothesis of a candidate: it is structured text of its encoding and length. Its p-value is the
    share of such strings, drawn from the letter pairs of the whole corpus, that look as random. Benjamini
    and Hochberg's rule over all candidates keeps the expected share of structured strings among those
    called random at ``rate``. The driver gets a count for each of DRAWS + 1 p-values at most.
    """
    _, cand, block, part, vector = names
    parts = scan.where(F.col(vector).isNotNull()).select(F.col(block).alias("block"), F.col(part).alias("part"), F.col(vector).alias("v"))
    found = scan.where(F.size(cand) > 0).select(F.explode(cand).alias("c")).select("c.class", "c.p")
    classes = [r["class"] for r in found.select("class").distinct().collect()]  # a row an encoding and length
    if not classes:
        return {}
    neighbours = joined_blocks(sum_blocks(parts, n_parts(scan)), STATES * STATES).reshape(STATES, STATES)
    nulls = null_tables(sorted({c // len(LENGTHS) for c in classes}), neighbours, seed)

    def ranks(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": [int(np.searchsorted(-nulls[c], -p, side="right")) for c, p in zip(pdf["class"], pdf["p"], strict=True)]}, dtype="int64")

    counts = sorted((r.k, r["count"]) for r in found.mapInPandas(ranks, "k long").groupBy("k").count().collect())
    total, below, last = sum(n for _, n in counts), 0, -1
    for k, n in counts:
        below += n
        if total * (k + 1) / (DRAWS + 1) <= rate * below:
            last = k
    # p passes if at most ``last`` null strings look as random
    return {c: float(nulls[c][last]) if 0 <= last < DRAWS else (math.inf if last < 0 else -1.0) for c in classes}


def found_spans(base: str, cand: str, cuts: dict[int, float]) -> Column:
    """Base spans and random strings, in order."""
    if not cuts:
        return F.sort_array(F.col(base))
    table = F.create_map(*(F.lit(x) for c, p in cuts.items() for x in (c, p)))
    random = F.transform(F.filter(cand, lambda c: c["p"] > F.element_at(table, c["class"])), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
    return F.sort_array(F.concat(base, random))


def secrets(docs: DataFrame, rate: float = 0.05, seed: int = 17) -> DataFrame:
    """doc_id, base, found: arrays of (start, kind, end) in code points; found holds base and random strings.

    Null text: empty, no spans. Null or repeated ids and rows: each row is scanned on its own. Empty
    table: no rows. Other columns are ignored.
    """
    names = ("base", "cand", "block", "part", "v")
    scan = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), names, ["doc_id"])
    return scan.where("v is null").select("doc_id", "base", found_spans("base", "cand", cutoffs(scan, names, rate, seed)).alias("found"))


def redacted(docs: DataFrame, rate: float = 0.05, mark: str = "[secret]", seed: int = 17) -> DataFrame:
    """The rows of ``docs`` with every secret in ``text`` replaced by ``mark``; n_chars, if there, follows.

    One scan: the rows are written with their spans, which are then cut out. Overlapping spans become one
    mark each that starts outside of those before it. Null text stays null; repeated rows stay; empty
    table: no rows. All columns are kept, whatever their names.
    """
    names = tuple(unused(docs, "_base", "_cand", "_block", "_part", "_v"))
    scan = scanned(docs, names, docs.columns)
    rows = scan.where(F.col(names[4]).isNull())
    spans, text = found_spans(names[0], names[1], cutoffs(scan, names, rate, seed)), F.col("text").cast("string")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))

    def cut(s: Column, x: Column) -> Column:
        more = F.when(x["start"] >= s["done"], F.concat(text.substr(s["done"] + 1, x["start"] - s["done"]), F.lit(mark))).otherwise("")
        return F.struct(F.concat(s["out"], more).alias("out"), F.greatest(s["done"], x["end"]).alias("done"))

    clean = F.aggregate(spans, start, cut, lambda s: F.concat(s["out"], text.substr(s["done"] + 1, F.length(text))))
    out = rows.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text).cast(docs.schema["text"].dataType)).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])  # a second argument of a filter's function would be the place in the array
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


QUERIES = {"op7_secret_battery": query}
ORACLES: dict[str, str] = {}
