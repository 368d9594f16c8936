"""Near duplicates, packing, mixing, fingerprints, chat and token counts."""

import collections
import hashlib
import random
import struct
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import chat, fingerprints, mixing, neardup, packing, rollups
from quire.session import scratch_path
from tests.llm.conftest import prose, rows_of


def windows(t, n=5):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_classes(rows):
    """Components of equal texts and of window similarity 0.8 or more."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [windows(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
                up[root(i)] = root(j)
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[root(i)].append(rows[i][0])
    return ordered(classes.values())


def ordered(classes):
    """Ids of classes in order, nulls last."""
    last = lambda i: (i is None, i or 0)
    return sorted((sorted(c, key=last) for c in classes), key=lambda c: [last(i) for i in c])


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = {int(x): float(w) for x, w in zip(rng.integers(0, 2**62, 300), rng.uniform(0.2, 9, 300))}
    b = {x: w * (0.5 if i < 60 else 1) for i, (x, w) in enumerate(a.items()) if not 60 <= i < 90}
    b |= {int(x): 2.0 for x in rng.integers(0, 2**62, 40)}
    both = a.keys() | b.keys()
    j = sum(min(a.get(x, 0), b.get(x, 0)) for x in both) / sum(max(a.get(x, 0), b.get(x, 0)) for x in both)
    row = np.array([0] * len(a) + [1] * len(b))
    args = row, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 3
    got = [(s[0] == s[1]).mean() for s in (neardup.dart_signatures(*args, 100, seed) for seed in range(40))]
    assert abs(np.mean(got) - j) < 0.025
    assert (neardup.dart_signatures(*args)[:2] > 0).all() and (neardup.dart_signatures(*args)[2] == 0).all()


def near_rows():
    """A chain, a hub with many near copies, copies, and clean texts."""
    rng, rows = random.Random(5), []
    hub = prose(200, 50).split()
    for i in range(60):
        w = list(hub)
        for k in rng.sample(range(200), rng.randint(1, 6)):
            w[k] = f"w{rng.randint(0, 10**9)}"
        rows.append((100 + i, " ".join(w)))
    step = prose(120, 51).split()
    for i in range(12):  # neighbours are alike, ends are not
        rows.append((200 + i, " ".join(step)))
        step = step[3:] + prose(3, 900 + i).split()
    rows += [(300 + i, prose(100, 300 + i)) for i in range(30)] + [(400, prose(200, 50)), (401, prose(200, 50))]
    return rows


def test_near_classes(spark, odd_docs, no_docs):
    extra = spark.createDataFrame(near_rows(), "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra).repartition(4)
    got = neardup.near_classes(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.class_id, r.class_size].append(r)
    want = brute_classes(rows_of(docs))
    assert len(got) == docs.count() and sum(r.keep for r in got) == len(want)
    # null-only classes share the null id
    named = ordered([r.doc_id for r in c] for k, c in by.items() if k[0] is not None)
    assert named == [c for c in want if any(i is not None for i in c)]
    assert all(r.class_id is None or r.class_id <= (r.doc_id if r.doc_id is not None else r.class_id) for r in got)
    out = neardup.drop_near_duplicates(odd_docs)
    assert out.schema.names == odd_docs.schema.names
    assert out.count() == len(brute_classes(rows_of(odd_docs)))
    assert neardup.near_classes(no_docs).count() == 0 and neardup.drop_near_duplicates(no_docs).count() == 0


def test_near_classes_go_past_failing_candidates(spark):
    """Texts with many plausible partners below the threshold, with buckets in
    one cell and in many."""
    rng, rows = random.Random(8), []
    base = prose(150, 70).split()
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 2, 3, 3, 4, 4])):
            w[k] = f"w{rng.randint(0, 10**9)}"
        rows.append((i + 1, " ".join(w)))
    want = brute_classes(rows)
    assert len(want) > 3 and max(map(len, want)) > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = collections.defaultdict(list)
    for r in neardup.near_classes(docs).collect():
        by[r.class_id].append(r.doc_id)
    assert ordered(by.values()) == want
    for size in ({"block": 7}, {"windows": 900}):
        table, _, labels = neardup.near_links(docs, **size)
        by = collections.defaultdict(list)
        for r in table.join(labels.withColumnRenamed("node", "md"), "md", "left").collect():
            by[r.label or r.md].append(r.doc_id)
        assert ordered(by.values()) == want


def test_near_classes_of_pasted_bodies(spark):
    """A body and the same body pasted 5 and 10 times have alike window sets."""
    bodies = [prose(100, 600 + i) for i in range(20)]
    rows = [(3 * i + k, " ".join([b] * n)) for i, b in enumerate(bodies) for k, n in enumerate((1, 5, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    by = collections.defaultdict(list)
    for r in neardup.near_classes(docs).collect():
        by[r.class_id].append(r.doc_id)
    assert ordered(by.values()) == brute_classes(rows) == [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(20)]


def test_cell_links_against_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 30, 60).astype(np.uint32)
    sets = []
    for i in range(24):
        x = base.copy()
        at = rng.choice(60, rng.integers(1, 7), replace=False)
        x[at] = rng.integers(0, 1 << 30, len(at))
        sets.append(np.unique(x))
    names, open_ = [f"m{i:02d}" for i in range(24)], [i >= 4 for i in range(24)]
    label = [names[0] if i < 4 else names[i] for i in range(24)]
    rows = [(i, True) for i in range(24) if open_[i]] + [(i, False) for i in range(24)]
    cell = pa.table({c: [f(i, left) for i, left in rows] for c, f in {
        "md": lambda i, _: names[i], "label": lambda i, _: label[i], "left": lambda _, left: left,
        "open": lambda i, _: open_[i], "set": lambda i, _: sets[i].tobytes()}.items()})
    group = lambda pairs: components_of([(label[a], label[b]) for a, b in pairs], sorted(set(label)))
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    want = group([(a, b) for a in range(24) for b in range(a) if alike(a, b) >= 0.8])
    assert 1 < len(want) < 21
    for expand in (1, 50, 1 << 21):
        got = neardup.cell_links(0.8, expand)(cell).to_pylist()
        pairs = [(int(r["a"][1:]), int(r["b"][1:])) for r in got]
        assert all(abs(alike(a, b) - r["similarity"]) < 1e-12 for (a, b), r in zip(pairs, got))
        assert group(pairs) == want and len(got) == len(set(label)) - len(want)
    assert neardup.cell_links()(cell.slice(0, 0)).num_rows == 0


def components_of(pairs, nodes):
    least = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(least[a], least[b])
            changed |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    by = collections.defaultdict(list)
    for x, y in least.items():
        by[y].append(x)
    return sorted(by.values())


def test_hilbert_neighbours_touch():
    p = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    k = packing.hilbert_key(p, 3)
    assert sorted(k) == list(range(512))
    assert np.abs(np.diff(p[np.argsort(k)], axis=0)).sum(1).max() == 1


def test_packing(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    from quire.llm.tokens import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows_of(odd_docs))
    rows = packing.pack(odd_docs, 512).collect()
    ids = [np.frombuffer(r.ids, "<u4") for r in rows]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(x) == r.length for r, x in zip(rows, ids))
    at = collections.defaultdict(list)
    for r, x in zip(rows, ids):
        at[r.sequence_id].append((r.offset, r.length, r.doc_id, r.start, x))
    lengths, stream = [], []
    for s in sorted(at):
        size = 0
        for offset, n, *rest in sorted(at[s], key=lambda v: v[0]):
            assert offset == size
            size += n
            stream.append(rest)
        lengths.append(size)
    assert sorted(at) == list(range(len(at)))
    assert all(n == 512 or n & (n - 1) == 0 for n in lengths) and sum(n != 512 for n in lengths) <= 9
    got, doc = collections.Counter(), []
    for i, start, x in stream:
        assert start == len(doc)
        doc += x.tolist()
        if doc[-1] == 2:
            got[i, tuple(doc)] += 1
            doc = []
    assert got == want and not doc
    assert packing.pack(no_docs).count() == 0


def filled(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, left, out = set(names), float(sum(sizes.values())), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark, odd_docs, no_docs):
    mix, per_doc = mixing.mix_sources(odd_docs)
    rows = per_doc.collect()
    sizes = collections.Counter()
    for r in odd_docs.select("source", "text").collect():
        sizes[r.source] += len((r.text or "").replace("　", "x").split())
    targets, taken = filled(sizes), collections.Counter()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= max(3, 0.02 * targets[s]) for s in sizes)
    again = mixing.mix_sources(odd_docs.repartition(3))[1]
    cols = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, again.select(cols).collect())) == sorted(map(str, per_doc.select(cols).collect()))
    # a prefix of the schedule is mixed already
    first = mix.where("slot < 200").join(per_doc.select("sid", "source").distinct(), "sid").groupBy("source").count().collect()
    assert len(first) >= 2
    out = mixing.apply_mix(odd_docs, per_doc)
    assert out.schema.names == odd_docs.schema.names
    assert out.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(r.taken for r in rows)
    assert mixing.mix_sources(no_docs)[1].count() == 0
    empty = mixing.mix_sources(odd_docs.where("text IS NULL"))[1].collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


def test_edited_texts_and_fingerprints(spark, odd_docs, no_docs):
    rows = sorted(rows_of(odd_docs), key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = collections.Counter()
    # rows with one id have one text here, null ids are last in either order
    known = [r for r in rows if r[0] is not None]
    for k in range(len(known) - 1):
        x, y = known[k][1] or "", known[k + 1][1] or ""
        n = len(x) // 2
        want[known[k][0], len(x), hashlib.sha256((x[: len(x) - n] + y[:n]).encode()).hexdigest()] += 1
    got = fingerprints.compare_edits(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert not want - collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].fingerprint == by[2].fingerprint and by[6].fingerprint == ""
    assert 0.3 < by[9].near_edited < 0.7 and by[9].near_next < 0.05
    assert all(0 <= v <= 1 for r in got for v in (r.near_edited, r.near_next))
    assert fingerprints.compare_edits(no_docs).count() == 0


def test_short_texts_are_like_their_edited_text(spark):
    """Half of a text of 6 to 40 words is shared, so its likeness is not 0."""
    rows = [(100 * n + k, prose(n, 7000 + 100 * n + k)) for n in [*range(6, 41), 60, 78, 82, 90] for k in range(4)]
    random.Random(6).shuffle(rows)
    got = fingerprints.compare_edits(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    n = {i: len(t.split()) for i, (_, t) in enumerate(rows)}
    low = [(n[r.doc_id], r.near_edited) for r in got if not 0 < r.near_edited < 0.9]
    assert len(got) == len(rows) and not low
    assert np.mean([r.near_edited for r in got]) > 0.2 and np.mean([r.near_next for r in got]) < 0.05


def test_anchors_are_context_free(spark):
    a = prose(200, 70)
    docs = spark.createDataFrame([(1, a), (2, "some other start " + a + " end")], "doc_id long, text string")
    found = fingerprints.anchors(docs)
    m = fingerprints.matched_anchors(found.where("doc_id = 1"), found.where("doc_id = 2")).collect()
    best = max(m, key=lambda r: r.n_anchors)
    assert best["shift"] == 3 and best.n_anchors >= 0.9 * found.where("doc_id = 1").count()


def _sketch(text):
    """Anchors of a fingerprint by plain Python: [(hash, first position)]."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    t = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in re.findall(r"[^\x20\x09-\x0D]{1,5}", text or "")]

    def run(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return signed(h)

    at = [i for i in range(len(t) - 2) if not t[i + 1] < min(t[i], t[i + 2])] if len(t) > 2 else [0][: len(t)]
    first = {}
    for i in at:
        first.setdefault(run(t[i : i + 3] if len(t) > 2 else t), i)
    every = sorted(first.items())
    return [x for i, x in enumerate(every) if i < 64 or x[0] < fingerprints.SHARE], at


def _alike(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    limit = min(max(x[63][0], fingerprints.SHARE - 1) if len(x) >= 64 else 1 << 63 for x in (a, b))
    x, y = ({h: at for h, at in z if h <= limit} for z in (a, b))
    shifts = collections.Counter(y[h] - x[h] for h in x if h in y)
    return max(shifts.values(), default=0) / len(x.keys() | y.keys())


def test_fingerprints_against_python(spark, odd_docs):
    more = [(100 + k, prose(n, 900 + k)) for k, n in enumerate([1, 2, 3, 5, 40, 60, 61, 90, 400, 3000, 3000])]
    passage = prose(100, 77)
    for k in (200, 201):  # two long texts with a passage of 100 words in common
        more.append((k, prose(20_000, k) + " " + passage + " " + prose(5_000, k + 10)))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {i: t or "" for i, t in rows_of(docs) if i is not None}
    rows = [r for r in fingerprints.compare_edits(docs).collect() if r.doc_id is not None]
    order = sorted(texts, reverse=True)
    nxt = dict(zip(order, order[1:]))
    for r in rows:
        own, _ = _sketch(texts[r.doc_id])
        assert r.fingerprint == "".join(f"{h % (1 << 64):016x}{at:08x}" for h, at in own)
        if r.doc_id in nxt and r.doc_id != 2:  # 2 is a repeated row
            x, y = texts[r.doc_id], texts[nxt[r.doc_id]]
            n = len(x) // 2
            assert r.near_edited == pytest.approx(_alike(own, _sketch(x[: len(x) - n] + y[:n])[0]))
            assert r.near_next == pytest.approx(_alike(own, _sketch(y)[0]))
    assert {r.doc_id: r.near_next for r in rows}[201] > 0


def test_anchors_against_python(spark):
    for t in (prose(80, 71), "one", "a b", "x" * 400, ""):
        got = [r.at for r in fingerprints.anchors(spark.createDataFrame([(1, t)], "doc_id long, text string")).orderBy("at").collect()]
        assert got == _sketch(t)[1]
        assert all(b - a <= 2 for a, b in zip(got, got[1:]))  # four tokens in a row hold an anchor


def test_chat_escape_round_trip():
    rng = random.Random(1)
    bits = ["<", "s", ">", "/", "[", "INST]", "[INST]", "\\", "<<SYS>>", "</s>", "<s>", "SYS", "[TURN]", "[/ROLE]", " "]
    for _ in range(5000):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(m in e for m in chat._ALL)


def test_chat_examples(spark):
    rows = [
        (1, 0, "system", "be [INST]"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo </s>"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 0, "user", "only"), (3, None, None, "x\\"), (3, 1, "tool[/ROLE]", "y"), (3, 2, "assistant", "z"), (3, 3, "user", "tail"),
        (None, 0, "assistant", "n"), (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"),
    ]
    turns = chat.with_probe(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    rows = rows + chat.PROBE
    ex = chat.expand_examples(turns)
    got = {r.conv_id: r for r in chat.read_back(ex).collect()}
    assert len(got) == 6
    for c, r in got.items():
        mine = sorted([(x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c])
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in mine)
        loss = "".join(text for *_, role, text in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    one = sorted(ex.where("conv_id = 1").collect(), key=lambda r: r.example)
    assert [r.n_turns for r in one] == [3, 5] and one[1].text.startswith(one[0].text)
    assert chat.unescape(one[0].text[one[0].loss_start : one[0].loss_end]) == "yo </s>"
    assert [r.loss_start for r in ex.where("conv_id = 3").orderBy("example").collect()][1] is None
    assert chat.read_back(chat.expand_examples(turns.limit(0))).count() == 0


CHANGE = "doc_id long, op string, seq int, source string, lang string, version string, tokens long, extra int"


def test_rollups(spark):
    roll = rollups.Rollup(spark, scratch_path(spark, "roll"))
    totals = lambda: {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    batch = lambda rows: spark.createDataFrame([(*r, 0) for r in rows], CHANGE)
    assert totals() == {}
    one = [(i, "upsert", 1, "a" if i % 3 else None, "en", "v1", 10 + i) for i in range(9)] + [(None, "upsert", 1, "a", None, "v1", 5)]
    assert roll.apply("1", batch(one + one[:2]))
    first = totals()
    assert first == {("a", "en", "v1"): (6, 10 * 6 + 27), (None, "en", "v1"): (3, 39), ("a", None, "v1"): (1, 5)}
    assert not roll.apply("1", batch(one)) and totals() == first
    # a batch that failed before its commit leaves no trace, and is redone
    batch(one).write.parquet(f"{roll.path}/ledger/2")
    assert totals() == first
    two = [(0, "delete", 2, None, None, None, None), (1, "upsert", 2, "b", "en", "v2", 99), (77, "delete", 2, None, None, None, None),
           (2, "upsert", 2, "x", "en", "v1", 1), (2, "upsert", 3, "a", "en", "v1", 20)]
    assert roll.apply("2", batch(two)) and roll.apply("3", batch([])) and not roll.apply("2", batch(two))
    want = {("a", "en", "v1"): (5, 87 - 11 - 12 + 20), (None, "en", "v1"): (2, 29), ("a", None, "v1"): (1, 5), ("b", "en", "v2"): (1, 99)}
    assert totals() == want
    assert roll.ledger().agg(F.sum("docs")).first()[0] == 9


def test_rollup_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "upsert", 1, "a", "en", "v", 4, 0)], CHANGE).coalesce(1).write.parquet(src)
    roll = rollups.Rollup(spark, f"{tmp_path}/roll")
    for _ in range(2):
        rollups.follow(spark.readStream.schema(CHANGE).parquet(src), roll, f"{tmp_path}/ck").awaitTermination()
    assert [(r.n_docs, r.n_tokens) for r in roll.totals().collect()] == [(1, 4)]


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "minhash_near_dedup", "secret_scan", "source_mix", "pack_sequences"]
    for name, stage in cp.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.columns == before.columns
        rows = rows_of(docs)
        if name == "minhash_near_dedup":
            assert sorted(i for i, _ in rows) == [c[0] for c in sorted(brute_classes(rows_of(before)))]
        if name == "secret_scan":
            assert len(rows) == before.count() and not any("AKIA" in t for _, t in rows)
    n = cp.STAGES[-1][1](spark, docs, sf).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert n.where("n > 4096 OR (n < 4096 AND n & (n - 1) <> 0)").count() == 0


def test_fingerprints_hold_every_anchor(spark):
    """Two texts of 4,000 words that share one short passage: its few anchors
    are counted, not guessed from a part."""
    passage = prose(6, 79)
    docs = spark.createDataFrame([(k, prose(4000, 300 + k) + " " + passage) for k in (1, 2)], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    for r in got.values():
        kept = fingerprints.anchors(docs.where(f"doc_id = {r.doc_id}")).select("hash").distinct().count()
        assert len(r.fingerprint) == 24 * kept
    (a, _), (b, _) = (_sketch(docs.where(f"doc_id = {k}").first().text) for k in (1, 2))
    assert got[2].near_next == pytest.approx(_alike(a, b)) and got[2].near_next > 0


def test_fingerprints_sort_without_a_lambda(spark, odd_docs):
    """No sort of anchors evaluates a lambda for every comparison."""
    plan = fingerprints.compare_edits(odd_docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
