"""More of the operators against brute force: passages, neighbours, gradients, random strings, batches, choices of the pipeline."""

import functools
import hashlib
import itertools
import random
import re
import resource
import string
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from conftest import SCHEMA, prose, rows_of
from pyspark.sql import functions as F

from trailframe.llm import common as C
from trailframe.llm import decontamination, line_crf, quality_knn, secrets, suffix_dedup, token_rollup

BASE = "/root/testdata/sf0.001"


def brute_passages(docs, items):
    """(doc, item, start, end, equal): every alignment, every stretch; then the best of those of one item that overlap in a chain."""
    out = []

    def cut(t):
        return re.findall(r"[^\W_]+", t.lower()) if t else []

    for d, text in docs:
        words = cut(text)
        for i, item in sorted({x for x in items if x[1] is not None}):
            want, best = cut(item), []
            if len(want) < 3:
                continue
            least = min(12, -(-4 * len(want) // 5))
            for start in range(1 - len(want), len(words)):
                same = [0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(want)]
                found = [(sum(same[a:b]), -a, b) for a in range(len(want)) if same[a] for b in range(a + least, len(want) + 1) if same[b - 1] and start + a >= 0 and start + b <= len(words)]
                found = [x for x in found if x[0] >= least and 5 * x[0] >= 4 * (x[2] + x[1])]
                if found:
                    equal = max(found)[0]
                    best.append((equal, [(start - a, start + b) for q, a, b in found if q == equal]))
            spans = sorted((min(s)[0], max(e for _, e in s), equal) for equal, s in best)
            while spans:  # chains of overlapping ones
                chain, rest, end = [spans[0]], [], spans[0][1]
                for x in spans[1:]:
                    if x[0] < end:
                        chain.append(x)
                        end = max(end, x[1])
                    else:
                        rest.append(x)
                out.append((d, i, max(q for *_, q in chain)))
                spans = rest
    return Counter(out)


def changed(words, share, r):
    return [w if r.random() > share else f"zz{r.randint(0, 99)}" for w in words]


def test_passages_by_brute_force(spark, monkeypatch):
    r = random.Random(21)
    items = [(k, prose(100 + k, n)) for k, n in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 22, 40))] + [(77, None), (78, "")]
    docs = []
    for k in range(120):
        parts = [prose(500 + k, r.randint(0, 12)).split()]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items[2:16])[1]).split()
            at = r.randint(0, max(0, len(w) - 5)) if r.random() < 0.3 else 0
            parts += [changed(w[at:], r.choice((0, 0.1, 0.2, 0.3)), r), prose(900 + k, r.randint(0, 4)).split()]
        docs.append((k, " ".join(w for p in parts for w in p)))
    docs += [(900, None), (901, ""), (None, items[14][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*items, items[9]], "item_id long, text string")
    want = brute_passages(docs, items)
    assert len(want) > 60
    got = [decontamination.find_passages(frame, bench).drop("key").collect()]
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 0)  # the shuffled way
    got.append(decontamination.find_passages(frame, bench).drop("key").collect())
    monkeypatch.setattr(decontamination, "PART", 3)  # buckets in very many parts
    got.append(decontamination.find_passages(frame, bench).drop("key").collect())
    for rows in got:
        assert Counter((x.doc_id, x.item_id, x.n_equal) for x in rows) == want
    assert Counter(map(tuple, got[0])) == Counter(map(tuple, got[1])) == Counter(map(tuple, got[2]))
    clean = {x.doc_id for x in decontamination.decontaminate(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _, _ in want}
    monkeypatch.undo()
    assert clean == {x.doc_id for x in decontamination.decontaminate(frame, bench).collect()}


def test_short_items_have_seeds():
    for n in range(decontamination.SHORTEST, 15):
        masks = [re.compile(m.replace("0", ".")) for m in decontamination.masks_of(n)]
        for k in range(n - decontamination.least_equal(n) + 1):
            for others in itertools.combinations(range(n), k):
                same = "".join("0" if i in others else "1" for i in range(n))
                assert any(m.search(same) for m in masks), same


def test_eleven_words_with_one_changed_and_shorter_ones():
    item = [f"w{k}" for k in range(11)]
    index = decontamination.Index([(1, " ".join(item)), (2, "The"), (3, "of the")])
    assert [h[:2] for h in index.find(["a b " + " ".join([*item[:5], "x", *item[6:]]) + " c of the"])] == [(0, 0)]


def test_repetitive_texts_need_little():
    index = decontamination.Index([(1, "so " * 60)])
    index.find(["so " * 100])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert index.find(["so " * 60_000]) == [(0, 0, 0, 60, 60)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_neighbours_by_brute_force():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "Bb", "c1", "##", "dd.", "EE!", "long", "word"], rng.integers(1, 30))) for _ in range(60)]
    labels = rng.integers(0, 2, 60)
    model = quality_knn.Model(quality_knn.terms([*texts, *texts[:20]]), np.r_[labels, 1 - labels[:20]], 8, 5)
    for text in [*texts[:30], "never seen", "a a a a"]:
        v = model._weigh(quality_knn.terms([text]))[0].astype(float) @ model.space.astype(float)
        v /= max(np.linalg.norm(v), 1e-12)
        near = sorted(((-round(float(v @ w) * 1e6), k) for k, w in enumerate(model.vectors.astype(float))))[:5]
        weight = [max(-d / 1e6, 0) ** 4 for d, _ in near]
        want = sum(w * model.labels[k] for w, (_, k) in zip(weight, near, strict=True)) / sum(weight)
        got = model.score([text])[0]
        edge = sorted(-round(float(v @ w) * 1e6) for w in model.vectors.astype(float))
        if edge[5] - edge[4] > 2 or edge[5] == edge[4]:  # single and double precision agree on the nearest
            assert abs(got - want) < 1e-3, text


def test_ties_go_to_the_first():
    counts = np.repeat(quality_knn.terms(["one two three"]), 6, axis=0)
    model = quality_knn.Model(counts, np.array([1, 1, 0, 0, 0, 0]), 4, 3)
    assert abs(model.score(["one two three"])[0] - 2 / 3) < 1e-6


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "Word word 12 ## same same same, end. " * 30 + "x" * 500 + " last"
    whole = quality_knn.terms([text])
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(quality_knn, "PIECE", piece)
        assert (quality_knn.terms([text]) == whole).all()
    monkeypatch.undo()
    long = text * 1200  # above 1 MiB
    assert len(long) > 1 << 20 and (quality_knn.terms([long])[0] > 0).sum() <= (whole[0] > 0).sum() + 8


def test_line_model_gradient():
    rng = np.random.default_rng(5)
    crf = line_crf.Crf(rng.normal(size=3), rng.normal(size=(2, 2)))
    sequences = [(rng.normal(size=(n, 3)), rng.integers(0, 2, n)) for n in (1, 2, 5, 3)]
    value = crf.likelihood(sequences)
    theta = np.r_[crf.weights, crf.move.ravel()]
    slope = value(theta)[1]
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-5
        assert abs((value(theta + step)[0] - value(theta - step)[0]) / 2e-5 - slope[k]) < 1e-5

    def score(x, path):
        return sum(float(x[t].astype(np.float32) @ crf.weights) * s for t, s in enumerate(path)) + sum(crf.move[a, b] for a, b in itertools.pairwise(path))

    exact = sum(score(x, y) - np.log(sum(np.exp(score(x, p)) for p in itertools.product((0, 1), repeat=len(x)))) for x, y in sequences)
    assert abs(value(theta)[0] * 11 - exact) < 1e-5


def test_lines_are_packed_whole():
    text = "\n".join(prose(k, 1 + k % 30) for k in range(300))
    x = line_crf.line_features(text.split("\n"))[0]
    assert len(x) == 300 and (line_crf.unpacked_lines(line_crf.packed_lines(text)) == x).all()
    assert line_crf.unpacked_lines(line_crf.packed_lines(None)).shape == (0, len(line_crf.FEATURES))


def test_random_strings_by_brute_force():
    enc = C.load_encoding(open(C.VOCABULARY, "rb").read())
    r = random.Random(31)
    keys = ["".join(r.choice(string.ascii_letters) for _ in range(30)) for _ in range(200)]
    assert sum(len(secrets.random_spans(k, enc, [])) for k in keys) >= 195  # of letters alone
    digest, uuid = hashlib.sha1(b"x").hexdigest(), "550e8400-e29b-41d4-a716-446655440000"
    alphabet = string.ascii_letters + string.digits + "+/_=-"
    for k in range(150):
        words = [r.choice((digest, uuid, digest.upper(), "1234567890" * 3, prose(k, 1), "".join(r.choice(alphabet) for _ in range(r.randint(15, 40))), "token='" + keys[k] + "'", "a" * 30, "0123456789abcdef0" + keys[k])) for _ in range(r.randint(0, 8))]
        text = r.choice((" ", "\n", ", ")).join(words)
        base, spans = secrets.scan_text(text, enc)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
            w = m[0]
            plain = re.fullmatch(r"[0-9a-fA-F]+", w) and len(w) in (32, 40, 56, 64, 96, 128) or re.fullmatch(r"[\d+/_=-]+", w) or re.fullmatch(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", w)
            inside = any(s <= m.start() and m.end() <= e for s, _, e in base)
            mixed = False
            for s in w.replace("_", "-").split("-"):
                threes = list(zip(s, s[1:], s[2:] + " ", strict=False))
                both = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
                mixed |= len(s) >= 8 and (both or any(a.islower() and b.isupper() or a.isupper() and b.isupper() and c.islower() for a, b, c in threes))
            if (len(w) >= 20 or len(w) >= 12 and mixed) and not plain and not inside and len(w) / len(enc.encode_ordinary(w)) < 2.0:
                want.append((m.start(), 3, m.end()))
        assert [x for x in spans if x[1] == 3] == want and [x for x in spans if x[1] < 3] == base


@pytest.mark.parametrize("n", [12, 14, 16, 19])
def test_short_keys_are_found(n):
    enc = C.load_encoding(open(C.VOCABULARY, "rb").read())
    r = random.Random(n)
    for alphabet, least in ((string.ascii_letters + string.digits, 196), (string.ascii_letters, 196), (string.ascii_lowercase + string.digits, 180)):
        keys = ["".join(r.choice(alphabet) for _ in range(n)) for _ in range(200)]
        assert sum(len(secrets.random_spans(f"the key {k} is", enc, [])) for k in keys) >= least


def test_prose_holds_no_short_keys(spark):
    """No word of 12 to 19 characters of the table's texts is taken for a key."""
    enc = C.load_encoding(open(C.VOCABULARY, "rb").read())
    texts = [r.text for r in C.read(spark, "/root/testdata/sf0.01", "documents").collect()]
    short = [t[s:e] for t in texts if t for s, _, e in secrets.random_spans(t, enc, secrets.base_spans(t)) if e - s < 20]
    assert short == []
    for word in ("JavaScript2024", "iPhone12ProMax", "getElementById", "COVID-19-related", "HTTPServerError", "self-supervised", "2024-05-06T10", "don_t_do_that_1"):
        assert secrets.random_spans(word, enc, []) == [], word


def test_digest_of_spans(spark, odd_docs):
    rows = {(r.doc_id, r.base_sha256) for r in secrets.scan_secrets(odd_docs).collect()}
    for i, t in rows_of(odd_docs):
        found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "") if len(m[2]) >= 12]
        found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        found.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        assert (i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()) in rows


def test_keys_with_hex_inside_go_whole(spark):
    enc = C.load_encoding(open(C.VOCABULARY, "rb").read())
    key = "Zq7RvT2mLw9K" + "0123456789abcdef" + "KzPb4NcYh8Xw"
    assert secrets.redact(f"a {key} b", secrets.scan_text(f"a {key} b", enc)[1]) == "a [SECRET] b"


def test_batches_of_any_name_and_compaction(spark, odd_docs, no_docs, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    load = token_rollup.deltas(odd_docs)
    names = ["2024/01", "a b", "../x", "%41", "A", ""]
    for n in names:
        assert rollup.commit(n, load) and not rollup.commit(n, load)
    assert rollup.committed() == set(names)

    def totals():
        return Counter({(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals().collect()})

    before = totals()
    assert sum(x[0] for x in before.values()) == len(names) * odd_docs.count()
    rollup.compact()
    assert totals() == before and rollup.committed() == set(names) and not rollup.commit("a b", load)
    assert rollup.commit("gone", load.withColumn("sign", -load.sign)) and rollup.commit("none", token_rollup.deltas(no_docs))
    folder = tmp_path / "r" / "base-000000000002"
    (folder / "sums").mkdir(parents=True)  # a compaction that was cut short
    after = totals()
    rollup.compact()
    assert totals() == after and {k: v[0] for k, v in after.items()} == {k: v[0] // 6 * 5 for k, v in before.items()}


def test_a_batch_of_two_drivers_counts_once(spark, odd_docs, tmp_path, monkeypatch):
    one, two = (token_rollup.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    load = token_rollup.deltas(odd_docs)
    assert one.commit("first", load)

    def totals():
        return sorted(map(str, one.totals().collect()))

    before = totals()
    monkeypatch.setattr(two, "_fresh", lambda *_: {})  # it looked before the other had written
    assert two.commit("first", load) and len(list((tmp_path / "r" / "batch-first").glob("attempt-*"))) == 2
    assert totals() == before
    (tmp_path / "r" / "batch-first" / f"attempt-{0:020d}-x").mkdir()  # a driver that was lost
    (tmp_path / "r" / "batch-lost" / f"attempt-{0:020d}-x").mkdir(parents=True)
    assert totals() == before and one.committed() == {"first"}
    one.compact()
    monkeypatch.setattr(two, "_named", lambda *_: spark.createDataFrame([], "name string"))
    assert two.commit("first", load)  # ends after the batch was compacted
    assert totals() == before and one.commit("lost", load) and one.committed() == {"first", "lost"}
    one.compact()
    halves = [f"n_{x} div 2 n_{x}" for x in ("docs", "tokens", "chars")]
    assert sorted(map(str, one.totals().selectExpr(*token_rollup.GROUP, *halves).collect())) == before
    assert {r.n_docs % 2 for r in one.totals().collect()} == {0}


def test_rollup_query_is_a_recount(spark):
    enc = C.load_encoding(open(C.VOCABULARY, "rb").read())
    want = Counter()
    for r in C.read(spark, BASE, "documents").collect():
        want[r.source, r.lang, "docs"] += 1
        want[r.source, r.lang, "tokens"] += len(enc.encode_ordinary(r.text or ""))
        want[r.source, r.lang, "chars"] += len(r.text or "")
    got = Counter()
    for r in token_rollup.op8_token_rollup(spark, BASE).collect():
        for k, v in (("docs", r.n_docs), ("tokens", r.n_tokens), ("chars", r.n_chars)):
            got[r.source, r.lang, k] += v
    assert +got == +want


def test_without_keys(spark):
    rows = spark.createDataFrame([(k % 50, f"v{k}") for k in range(200)], "k long, v string").repartition(5)
    out = C.without_keys(rows, "k", spark.range(10).withColumnRenamed("id", "k"), spark.range(20, 30).withColumnRenamed("id", "k"))
    got = Counter(r.k for r in out.collect())
    assert got == {k: 1 if 20 <= k < 30 else 4 for k in range(10, 50)}
    assert {r.v for r in out.collect() if 20 <= r.k < 30} == {min(f"v{k + 50 * j}" for j in range(4)) for k in range(20, 30)}


def test_filters_grow_with_what_they_mark(spark, monkeypatch):
    marked = C.marked
    rows = spark.range(3000).withColumn("v", F.col("id") % 7)
    hashed = spark.createDataFrame(pd.DataFrame({"bit": C.bit_hash(np.arange(1000))}))
    for width, widest, made in ((6, 6, 6), (6, 10, 10), (12, 20, 13), (16, 20, 16)):
        flags = marked(hashed, width, widest)
        assert len(flags) * 8 == 1 << made
        assert C.is_marked(flags, np.arange(1000)).all()
        others = C.is_marked(flags, np.arange(1000, 9000)).mean()
        assert others < 0.16 if made > 10 else others > 0.5
        monkeypatch.setattr(C, "marked", functools.partial(marked, width=width, widest=widest))
        out = C.without_keys(rows, "id", spark.range(1000), spark.range(1000, 1100))
        assert sorted(r.id for r in out.collect()) == list(range(1000, 3000))
    assert not C.is_marked(marked(hashed.limit(0), 6, 10), np.arange(100)).any()


def test_duplicates_are_chosen_alike(spark, odd_docs):
    def kept(docs):
        return sorted(map(str, corpus_pipeline.near_duplicates(spark, docs, BASE).collect()))

    rows = odd_docs.collect()
    rows += [rows[3], *[r for r in rows if r.doc_id is None]]
    rows += [type(rows[0])(**{**rows[0].asDict(), "lang": "zz"}), type(rows[0])(**{**rows[0].asDict(), "doc_id": None})]
    one = kept(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert one == kept(spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1)) == kept(spark.createDataFrame(rows, SCHEMA).repartition(7, "text"))
    docs = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), BASE).collect()
    texts = Counter(r.text for r in docs if (r.text or "").split())
    assert max(texts.values()) == 1  # one of equal texts, whatever the id
    assert Counter(r.doc_id for r in docs)[4] == 2  # two texts under one id are two documents
    assert sum(r.doc_id is None for r in docs) == 1 and sum(not (r.text or "").split() for r in docs) == sum(not (r.text or "").split() for r in rows)


def test_stages_by_brute_force(spark):
    """The stages that decide by rule, on what the classifier keeps: against plain versions."""
    docs = C.checkpoint(corpus_pipeline.quality(spark, C.read(spark, BASE, "documents"), BASE))
    model = quality_knn.fit(C.read(spark, BASE, "documents"), C.read(spark, BASE, "labels"))
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in C.read(spark, BASE, "documents").collect() if model.score([r.text])[0] >= quality_knn.CUT}
    near = C.checkpoint(corpus_pipeline.near_duplicates(spark, docs, BASE))
    from test_operators import brute_components

    label = {i: c for i, _, c in brute_components(rows_of(docs))}
    assert {r.doc_id for r in near.collect()} == {i for i, c in label.items() if i == c}
    clean = C.checkpoint(corpus_pipeline.benchmark(spark, near, BASE))
    items = [(r.item_id, r.text) for r in C.read(spark, BASE, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in near.collect()}
    gone = set(texts) - {r.doc_id for r in clean.collect()}
    grams = {}
    for i, t in items:
        w = re.findall(r"[^\W_]+", t.lower())
        for k in range(len(w) - 3):
            grams.setdefault(tuple(w[k : k + 4]), set()).add(i)
    for d, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        ids = {i for k in range(len(w) - 3) for i in grams.get(tuple(w[k : k + 4]), ())}
        some = [x for x in items if x[0] in ids]
        assert bool(some and brute_passages([(d, t if len(w) < 2000 else " ".join(w))], some)) == (d in gone) or len(w) >= 2000, d
    enc = C.load_encoding(open(C.VOCABULARY, "rb").read())
    for r in corpus_pipeline.secret_scan(spark, clean, BASE).collect():
        marks = ["" if r.text is None else c for c in texts[r.doc_id] or ""]
        for s, _, e in secrets.scan_text(texts[r.doc_id], enc)[1]:
            marks[s:e] = ["\0"] * (e - s)
        assert re.sub("\0+", "[SECRET]", "".join(marks)) == (r.text or ""), r.doc_id


def brute_maximal(rows, least=200):
    """All maximal repeats by comparing suffixes: strings of two places or more that no byte on either side continues at all places."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    sorted_ = sorted(((t[p:], i, p, t) for i, t in texts for p in range(len(t))), key=lambda x: x[0])

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    lcp = [common(a[0], b[0]) for a, b in itertools.pairwise(sorted_)]
    out = {}
    for k, n in enumerate(lcp):
        if n < least:
            continue
        lo = hi = k
        while lo and lcp[lo - 1] >= n:
            lo -= 1
        while hi + 1 < len(lcp) and lcp[hi + 1] >= n:
            hi += 1
        places = frozenset((i, p) for _, i, p, _ in sorted_[lo : hi + 2])
        before = {t[p - 1] if p else (i, "start") for _, i, p, t in sorted_[lo : hi + 2]}
        if len(before) > 1:
            out[sorted_[k][0][:n]] = places
    return {(len(k), v) for k, v in out.items()}


def test_groups_are_all_maximal_repeats(spark):
    r = random.Random(41)

    def noise(n):
        return "".join(r.choice("abcdefghé \n") for _ in range(n))

    a, b, c, d = noise(230), noise(900), noise(1700), noise(260)
    rows = [(1, noise(60) + a + noise(30) + b), (2, b + a + noise(10)), (3, c + noise(5) + c[:800] + noise(7) + b[300:]), (4, noise(20) + c), (5, d + d + noise(9) + d), (6, a), (7, a), (8, a + b + noise(3)), (9, None), (10, noise(250))]
    found = {}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for g in suffix_dedup.repeat_groups(docs).collect():
        found.setdefault((g.group_id, g.length), set()).add((g.doc_id, g.start))
    got = Counter((n, frozenset(v)) for (_, n), v in found.items())
    assert set(got) == brute_maximal(rows) and max(got.values()) == 1 and max(n for n, _ in got) > 1600


def test_long_repeats_are_given_in_pieces(spark):
    r = random.Random(43)
    passage = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(k, f"{k}" * 5 + passage + f"{k}") for k in range(3)]
    found = suffix_dedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), reach=400).collect()
    covered = {k: set() for k in range(3)}
    for g in found:
        covered[g.doc_id].update(range(g.start, g.start + g.length))
    assert all(covered[k] == set(range(5, 3005)) for k in range(3))


@pytest.mark.parametrize("hot", [1, suffix_dedup.HOT])
def test_removal_from_texts_above_a_segment(spark, hot):
    from test_operators import brute_repeats, cut

    r = random.Random(47)
    text = "".join(r.choice("ab ") for _ in range(500))
    edge = suffix_dedup.SEGMENT
    noise = "".join(r.choice("abcdefgh ") for _ in range(edge + 2000))
    rows = [(1, noise + text + "\x00" * 450 + noise[700:1900]), (2, "x" * 900), (3, noise[:300] + text), (4, noise[edge - 400 : edge + 150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(cut(docs, hot=hot)) == Counter(brute_repeats(rows))
