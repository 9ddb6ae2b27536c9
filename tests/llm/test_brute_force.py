"""The operators against plain versions on a small table, and statistical checks where there is no plain version."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_oracles_agree(spark):
    duckdb = pytest.importorskip("duckdb")
    from kinfold.llm import oracles, queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracles.oracle_sql().items():
        ours = queries.queries()[name](spark, SF)
        columns = sorted(ours.columns)
        rel = con.sql(sql)
        order = [rel.columns.index(c) for c in columns]
        a = sorted((tuple(r[c] for c in columns) for r in ours.collect()), key=str)
        b = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
        assert a == b, name


def test_scores_of_the_language_model(spark, texts):
    from kinfold.llm.katz_lm import discounts
    from kinfold.llm.queries import queries

    words = {d: [*t.encode().translate(LOWER).split(), "END"] for d, t in texts.items()}
    train = [d for d in words if zlib.crc32(str(d).encode()) % 7 != 2]
    uni, bi, after = collections.Counter(), collections.Counter(), collections.defaultdict(dict)
    for d in train:
        uni.update(words[d])
        bi.update(zip(["BEGIN", *words[d][:-1]], words[d], strict=True))
    for (a, b), c in bi.items():
        after[a][b] = c
    n, v = sum(uni.values()), len(uni)
    counted = lambda c: [collections.Counter(c.values())[r] for r in range(1, 7)]
    du, db = discounts(counted(uni), 5), discounts(counted(bi), 5)
    held = lambda d, c: (d[c] if c <= 5 else 1) * c
    p = {w: held(du, c) / n for w, c in uni.items()}
    unknown = 1 - sum(p.values())
    state = {}
    for a, f in after.items():
        total = uni[a] if a != "BEGIN" else len(train)
        left = total - sum(held(db, c) for c in f.values())
        if left < 1e-9 * total:
            left, total = 1, total + 1
        state[a] = left / total / (1 - sum(p[b] for b in f)), total
        mass = sum(held(db, c) / total for c in f.values()) + state[a][0] * (1 - sum(p[b] for b in f))
        assert abs(mass - 1) < 1e-9  # normalised exactly
    got = {r["doc_id"]: r for r in queries()["op10_katz_scoring"](spark, SF).collect()}
    for d, own in words.items():
        s = b0 = 0.0
        for a, w in zip(["BEGIN", *own[:-1]], own, strict=True):
            c = after.get(a, {}).get(w, 0)
            s += math.log10(held(db, c) / state[a][1] if c else (state[a][0] if a in state else 1) * p.get(w, unknown))
            b0 += math.log10((uni[w] + 1) / (n + v + 1))
        r = got[d]
        assert math.isclose(r["score"], s, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r["base_score"], b0, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(uni[w] > 0 for w in own), n)


def test_pieces_are_the_tokenizers_own(spark, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from kinfold.llm.queries import queries

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = collections.defaultdict(list)
    rows = queries()["op6_best_fit_packing"](spark, SF).collect()
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got[d]) == [(p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_units_with_odd_characters():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from kinfold.llm.best_fit_packing import WordIds

    path = P.path("word_bpe_49k.json")
    t, mine, rng = Tokenizer.from_file(path), WordIds(path), random.Random(3)
    t.encode_special_tokens = True
    alphabet = ["a", "B", "é", "É", "İ", "ß", "ñ", "1", "2", ".", ",", "'", "'s", "…", "—", "日", "́", " ", "\n", " ", "$", "_", "İstanbul", "don't", "Σ"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        b = np.frombuffer(text.encode(), np.uint8)
        assert mine.ids(b, np.array([0, len(b)]))[0].tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_keep_their_ids():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from kinfold.llm.best_fit_packing import WordIds

    path = P.path("word_bpe_49k.json")
    t, mine, rng = Tokenizer.from_file(path), WordIds(path), random.Random(4)
    alphabet = ["a page", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "<", "|>", "'s", "'", "e", "\u0301", "7", " ", "\n", "é", "—", "İ"]
    texts_ = ["a page <|endoftext|> next", "<|endof", "text|>", "", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 20))) for _ in range(400))]
    raw = [x.encode() for x in texts_]
    ids, at = mine.ids(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, x in enumerate(texts_):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_quality_on_held_out_rows(spark):
    from kinfold.llm.queries import queries

    sf = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in queries()["op2_quality_classifier"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_signatures_cover_every_link():
    """Pairs of sets at and just above the threshold share a signature, at every size; the number of signatures is bounded."""
    from kinfold.llm.jaccard_join import signatures

    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 60, 100, 333, 1000, 4000]:
        for _ in range(12 if n < 100 else 3):
            a = rng.integers(1, 1 << 62, n).astype(np.uint64)
            out = int(rng.integers(0, n + 1))
            b = None
            while b is None:  # as many elements out and in as the threshold allows
                new = int(rng.integers(0, max(1, n // 4) + 1))
                if 100 * (n - out) >= 80 * (n + new) and n - out > 0:
                    b = np.concatenate([a[out:], rng.integers(1, 1 << 62, new).astype(np.uint64)])
                out //= 2
            sizes = np.array([len(a), len(b)])
            docs, sigs = signatures(np.repeat([0, 1], sizes), np.concatenate([a, b]), sizes, 80)
            same = len(a) == len(b) and set(a.tolist()) == set(b.tolist())
            assert same or set(sigs[docs == 0].tolist()) & set(sigs[docs == 1].tolist()), (n, len(b))
            assert len(sigs) < 4 * sizes.sum() + 20


def _drawn(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_secret_battery_finds_drawn_strings_of_every_encoding(spark, texts):
    """Strings drawn at random, put into real texts: recall by encoding, through the operator; words of text are left alone."""
    from kinfold.llm.secret_scan import _ALPHABETS, _DIGITS, battery, scan_secrets

    rng = random.Random(1)
    names = [a for a in _ALPHABETS if a != _DIGITS]
    rows, planted = [], {}
    for i, a in enumerate(names):
        for j in range(40):
            secret = _drawn(rng, a, 40)
            planted[1000 * i + j] = (i, secret)
            rows.append((1000 * i + j, f"{texts[(7 * i + j) % len(texts)] or ''} {secret} end"))
    got = {r["doc_id"]: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [0] * len(names)
    for d, (i, secret) in planted.items():
        at = dict(rows)[d].rindex(secret)
        found[i] += any(s <= at and e >= at + 40 for s, e in zip(got[d]["starts"], got[d]["ends"], strict=True))
    assert min(found) >= 36, dict(zip(names, found, strict=True))
    words = ["information", "internationalization", "configuration", "thelongestwordinthissentence"]
    clean = [(i, " ".join("".join(rng.choice(words) for _ in range(3)) for _ in range(5))) for i in range(100)]
    mixed = spark.createDataFrame([*clean, *((10_000 + d, t) for d, t in rows)], "doc_id long, text string")
    assert not [r for r in scan_secrets(mixed).where("doc_id < 1000").collect() if r["doc_id"] < 100 and "random" in r["kinds"] and planted.get(r["doc_id"]) is None]
    uniform = [min(battery(_drawn(rng, "0123456789abcdef", 64))) for _ in range(300)]
    assert sum(p < 0.01 for p in uniform) < 20


def test_base_patterns_against_a_plain_scan(spark, texts):
    """Every text of the table, character by character, without the prefilters."""
    import hashlib
    import re

    from kinfold.llm.queries import queries

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    got = {r["doc_id"]: r for r in queries()["op4_secret_scan"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for d, text in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert got[d]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), d
        assert [got[d][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == i for _, k, _ in spans) for i in range(3)]
    assert len(got) == len(docs)


def _plain_words(text):
    import re

    return [w for w in re.split("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def test_licenses_against_a_plain_scan(spark, texts):
    """Base phrases and diagonal spans of every text, and of texts with templates worked in, word by word."""
    from kinfold.llm.license_scan import PHRASES, TEMPLATES, scan_licenses

    rng, rows = random.Random(4), [(d, t) for d, t in texts.items()]
    for i, (name, body) in enumerate(TEMPLATES.items()):
        words = body.split()
        worn = [w for j, w in enumerate(words) if j % 17 != 5]  # a word in seventeen is lost
        rows += [(10**6 + 10 * i, f"before {body} after"), (10**6 + 10 * i + 1, " ".join(worn)), (10**6 + 10 * i + 2, " ".join(words[: max(6, len(words) // 5)])), (10**6 + 10 * i + 3, " ".join(rng.sample(words, len(words))))]
    grams = {}
    for name, body in TEMPLATES.items():
        w = _plain_words(body)
        grams[name] = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, text in rows:
        w = _plain_words(text)
        places = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in PHRASES}
        every = [i for v in places.values() for i in v]
        base = {PHRASES[p] for p, v in places.items() if v}
        best, more = 0.0, set()
        for name, own in grams.items():
            at = collections.defaultdict(list)
            for t, g in enumerate(own):
                at[g].append(t)
            hits = sorted((p - t, p, t) for p in range(len(w) - 4) for t in at.get(tuple(w[p : p + 5]), ()))
            spans = []
            for diagonal, p, t in hits:
                if not spans or diagonal - spans[-1][0] > 4:
                    spans.append([diagonal, set(), p, p])
                s = spans[-1]
                s[0], s[2], s[3] = diagonal, min(s[2], p), max(s[3], p)
                s[1].add(t)
            for _, ts, lo, hi in spans:
                if len(ts) >= 0.5 * len(own) and hi + 5 - lo <= 2 * (len(own) + 5):
                    more.add(name)
                    best = max(best, len(ts) / len(own))
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(every), min(every, default=None), max(every, default=None)), d
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | more)), d
        assert r["score"] == pytest.approx(1.0 if every else best)


def test_tree_walk_and_features():
    """Flattened trees against a walk row by row; features of a text alone and among others."""
    from kinfold.llm.quality_classifier import FEATURES, features, fit

    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] + x[:, 1] * x[:, 3] > 0.2).astype(float)
    model = fit(x, y, trees=25, depth=3)
    plain = []
    for row in x:
        total = model.base
        for f, t, lo, hi, v in zip(model.feature, model.threshold, model.left, model.right, model.value, strict=True):
            at = 0
            while lo[at] != at:
                at = lo[at] if row[f[at]] <= t[at] else hi[at]
            total += v[at]
        plain.append(1 / (1 + math.exp(-total)))
    assert np.allclose(model.score(x), plain, atol=1e-12)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.9
    own = ["", "One two two.\nOne two two.\n", "Ünïcode wörds & SYMBOLS!! 123", "a " * 500]
    raw = [t.encode() for t in own]
    joint = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    alone = [features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in raw]
    assert joint.shape == (4, len(FEATURES)) and np.allclose(joint, alone) and not joint[0].any()


def test_packing_improves_a_tight_instance():
    """Pieces cut from full bins: best-fit decreasing needs more bins than there were, the genetic algorithm fewer than it."""
    from kinfold.llm.best_fit_packing import _Shard

    rng = np.random.default_rng(8)
    lengths = []
    for _ in range(60):
        cuts = np.sort(rng.choice(np.arange(1, 1000), 2, replace=False))
        lengths += np.diff([0, *cuts, 1000]).tolist()
    s = _Shard(np.array(lengths), 1000, 5)
    first = s.begin(0.0)
    assert s.bound == 60 and len(first) > 60
    crossed = []
    s.cross, plain = lambda a, b, f=s.cross: crossed.append(1) or f(a, b), s.cross
    best = s.evolve([], 8, 300)
    assert crossed and s.fitness(best) < s.fitness(first)
    assert sorted(i for b in best for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 1000 for b in best)
    child = plain(first, best)  # injects whole bins, drops duplicates, places the displaced
    assert sorted(i for b in child for i in b) == list(range(len(lengths)))


def test_elites_migrate(spark):
    """A tight shard on several islands over two epochs: every piece is placed once, no sequence overflows."""
    from kinfold.llm.best_fit_packing import pack_pieces

    rng = np.random.default_rng(9)
    rows = []
    for k in range(40):
        cuts = np.sort(rng.choice(np.arange(1, 500), 2, replace=False))
        rows += [(3 * k + j, 0, 0, int(n), 0) for j, n in enumerate(np.diff([0, *cuts, 500]))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = pack_pieces(pieces, 500, 1000, 3, 2, 6, 40).collect()
    fill = collections.Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert len(got) == 120 and max(fill.values()) <= 500 and 40 <= len(fill) <= 46


@pytest.mark.parametrize(("length", "epochs"), [(100, 1), (300, 3)])
def test_no_epochs_beyond_the_bound(spark, monkeypatch, length, epochs):
    """Islands that have reached the lower bound aren't run and written again; others are (no two pieces of 300 share a bin of 500)."""
    from kinfold.llm import best_fit_packing as packing

    written = []
    for name in ("stored", "counted"):
        plain = getattr(packing, name)
        monkeypatch.setattr(packing, name, lambda df, table, f=plain, **b: written.append(table) or f(df, table, **b))
    pieces = spark.createDataFrame([(i, 0, 0, length, 0) for i in range(60)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(pieces, 500, 1000, 2, 3, 4, 5).collect()
    assert len({r["doc_id"] for r in got}) == 60 and len({r["sequence_id"] for r in got}) == (12 if length == 100 else 60)
    assert written == ["elites"] * epochs


def test_pipeline_against_plain_stages(spark):
    """Each stage on its own input: what goes is what a plain version says."""
    import corpus_pipeline
    from kinfold.llm.queries import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    scored = {r["doc_id"]: r["predicted"] for r in queries()["op2_quality_classifier"](spark, SF).collect()}
    assert ids(corpus_pipeline.quality(spark, docs, SF)) == sorted(d for d, p in scored.items() if p)
    sets = {}
    for d, t in docs.select("doc_id", "text").collect():
        w = (t or "").encode().translate(LOWER).split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert ids(corpus_pipeline.dedup(spark, docs, SF)) == [d for d in order if top(d) == d]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = _plain_words(r["text"] or "")
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else ({tuple(w)} if w else set())
    sizes = {len(w) for w in windows}
    clean = []
    for d, t in docs.select("doc_id", "text").collect():
        w = _plain_words(t or "")
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean.append(d)
    assert ids(corpus_pipeline.decontaminate(spark, docs, SF)) == sorted(clean)


def test_pipeline(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        if name != "secrets":
            assert after.exceptAll(before).isEmpty(), name
        else:
            assert after.count() == before.count()
        before = after
    rows = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert rows.select("doc_id").distinct().count() == before.count()
