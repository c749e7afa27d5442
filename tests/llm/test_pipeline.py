"""Each stage against plain Python on a fixture with nulls, repeated rows, ties and clashing columns."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trolley.llm import curve_pack, pivotal_mix, quality_net, secret_battery
from trolley.llm.common import token_ids, vocabulary

CLASH = ("m", "total", "_s", "_d", "_h", "_n", "_c", "_k", "_id", "_text", "run", "node", "label", "label_", "base", "n", "size", "p", "level", "first", "v")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    out = [(None, "a b c d e f", "s0"), (0, None, None), (1, "", "s0"), (2, "   ", "s1"), (3, "one two", None)]
    for k in range(4, 60):
        text = [rng.choice(words) for _ in range(90)]
        out.append((k, " ".join(text), f"s{k % 3}" if k % 7 else None))
        if k % 6 == 0:
            out.append((k, " ".join(text), f"s{k % 3}" if k % 7 else None))  # a repeated row
            out.append((100 + k, " ".join(text), "s1"))
            out.append((200 + k, " ".join([*text[:-1], "end"]), "s2"))
            out.append((300 + k, " ".join([*text[:-25], *(rng.choice(words) for _ in range(25))]), "s2"))
        if k % 9 == 0:
            out.append((400 + k, "password=abcdefgh12 " + " ".join(text[::-1]), "s0"))
    return out + [(500, " ".join(rng.choice(words) for _ in range(30_000)), "s0")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    table = spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    return table.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH))).cache()


def key(df):
    return sorted(str((r.doc_id, r.text, r.source)) for r in df.collect())


def test_stages_are_those_of_the_task():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "packing"]


def test_quality_stage(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], int(r[0] % 2)) for r in rows if r[0] is not None], "doc_id long, quality int")
    got = quality_net.kept_documents(docs, labels)
    verdict = {(r.doc_id, r.text_hash): r.predicted for r in quality_net.quality_scores(docs, labels).collect()}
    hashed = docs.select("doc_id", "text", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    assert got.columns == docs.columns and key(got) == sorted(str((r.doc_id, r.text, r.source)) for r in hashed if verdict[r.doc_id, r.h])
    assert quality_net.kept_documents(docs.limit(0), labels).count() == 0


def test_join_stage(spark, docs, rows):
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if z in (x, y) else z for z in label]
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[label[k] if sets[k] and r[0] is not None else -1 - k].append(r)
    want = sorted(str(min(g, key=lambda r: (r[0] is None, r[0])) if len(g) > 1 else g[0]) for g in groups.values())
    got = corpus_pipeline.deduplicate(spark, docs, "")
    assert got.columns == docs.columns and key(got) == want
    assert corpus_pipeline.deduplicate(spark, docs.limit(0), "").count() == 0


def test_secret_stage(spark, docs, rows):
    got = corpus_pipeline.redact(spark, docs, "")
    cut = lambda t: t and secret_battery.ASSIGN.sub("[secret]", t)
    assert got.columns == docs.columns and key(got) == sorted(str((r[0], cut(r[1]), r[2])) for r in rows)
    assert corpus_pipeline.redact(spark, docs.limit(0), "").count() == 0


def plain_targets(rows):
    size = collections.Counter()
    for _, text, source in rows:
        size[source] += len((text or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), float(sum(size.values())), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return size, target | share
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)


def test_mixing_stage(spark, docs, rows):
    size, target = plain_targets(rows)
    units = pivotal_mix.pivotal_mix(docs).collect()
    assert len(units) == len(rows) and all(r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) for r in units)
    assert collections.Counter((r.doc_id, r["size"]) for r in units) == collections.Counter((d, len((t or "").split())) for d, t, _ in rows)
    got = corpus_pipeline.mix(spark, docs, "")
    took, words, most = collections.Counter((r.doc_id, r.text, r.source) for r in got.collect()), collections.Counter(), collections.Counter()
    have = collections.Counter(rows)
    for (d, t, s), n in took.items():
        words[s] += n * len((t or "").split())
        most[s] = max(most[s], len((t or "").split()))
        rate = target[s] / size[s] * have[d, t, s]
        assert int(rate) <= n <= int(rate) + 1 <= 3 * have[d, t, s] + 1
    assert got.columns == docs.columns and set(took) <= set(rows) and all(abs(words[s] - target[s]) <= most[s] for s in words)
    assert key(got) == key(corpus_pipeline.mix(spark, docs.repartition(5), "")) and corpus_pipeline.mix(spark, docs.limit(0), "").count() == 0


def test_packing_stage(spark, docs, rows):
    pieces = curve_pack.curve_pack(docs).collect()
    whole = collections.defaultdict(dict)
    for r in pieces:
        whole[r.doc_id, r.doc_tokens].setdefault(r.start, []).append(bytes(r.ids))
    import numpy as np

    want = collections.Counter((r[0], np.asarray(token_ids(r[1] or "", vocabulary()), "<u4").tobytes()) for r in rows)
    by_id = collections.Counter()
    for (d, _), starts in whole.items():
        for k in range(max(map(len, starts.values()))):
            by_id[d] += sum(len(x[k]) for x in starts.values() if k < len(x))
    assert by_id == collections.Counter({d: sum(len(x) * n for (e, x), n in want.items() if e == d) for d in {r[0] for r in rows}})
    once = [(d, x) for (d, x), n in want.items() if n == 1 and sum(e == d for e, _ in want) == 1]
    for d, x in once:
        own = whole[d, len(x) // 4]
        assert b"".join(own[s][0] for s in sorted(own)) == x
    assert corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0


def test_run(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1) for r in rows if r[0] is not None], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and all(0 <= r.offset and r.offset + r.length <= 1024 for r in got)
