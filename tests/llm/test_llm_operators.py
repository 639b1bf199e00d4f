"""Each operator against a plain version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from ctxloom.llm import archive, blocks, fingerprint, mixing, nearjoin, neighbours, packing, personal, quality, substrings, toxicity, wordhash
from ctxloom.llm.wordhash import gram_hashes, text_buffer, word_bounds, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé一") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 34, 35, 36, 80, 200]))]
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        texts.append(rng.choice([" ", "\n", "\t ", "  "]).join(words))
    for i in range(0, n, 3):
        words = texts[i].split(" ")
        if len(words) > 50:
            words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [texts[1], texts[1], None, "", "   ", "A" * 40, "x y", "X Y", " ".join(["same"] * 90), " ".join(vocabulary * 20)]
    rows = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, "no id here at all", None, "z", 17)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def test_word_hashes_follow_words_alone():
    texts = ["a bc  a", None, "", "bc\ta", "abca"]
    data, offsets = text_buffer(pa.array(texts))
    starts, ends, first = word_bounds(data, offsets)
    assert [data[s:e].tobytes() for s, e in zip(starts, ends)] == [b"a", b"bc", b"a", b"bc", b"a", b"abca"]
    assert first.tolist() == [0, 3, 3, 3, 5, 6]
    h = word_hashes(data, starts, ends)
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert gram_hashes(h, 2)[1] == gram_hashes(h, 2)[3]


def plain_mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


MASK = 2**64 - 1


def plain_simhash(text):
    """Votes of each pair of words, summed bit by bit."""
    words = words_of(text)
    table = [int(x) for x in wordhash._BYTES]
    hashed = [plain_mix((sum(table[c] * pow(wordhash._P, j, 2**64) for j, c in enumerate(w)) + len(w)) & MASK) for w in words]
    if len(words) == 1:
        terms = [(plain_mix(hashed[0] * 0x2545F4914F6CDD1D & MASK), len(words[0]))]
    else:
        terms = [(plain_mix((a + b * wordhash._P + 2) & MASK), len(u) + len(v)) for a, b, u, v in zip(hashed, hashed[1:], words, words[1:])]
    votes = [sum(min(n, 24) * (1 if h >> i & 1 else -1) for h, n in terms) for i in range(64)]
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def test_fingerprints_are_sums_of_votes():
    texts = [r[1] for r in corpus()]
    assert fingerprint.simhash(pa.array(texts)).tolist() == [plain_simhash(t) for t in texts]


@pytest.mark.parametrize("heavy", [False, True])
def test_fingerprints(spark, docs, empty, heavy):
    rows = corpus() + ([(40, f"text {i} of one id", "en", "s", 0) for i in range(90)] if heavy else [])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    named = {r[0]: r[1] for r in docs.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, ''))").distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -named[r[1] or ""], r[1] or ""))
    got = [tuple(r) for r in fingerprint.edited_fingerprints(docs).collect()]
    assert len(got) == len(order)
    want = Counter()
    prints = {t: int(p) for t, p in zip(named, fingerprint.simhash(pa.array(list(named))))}
    for k, (doc_id, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, new, after = prints[text], int(fingerprint.simhash(pa.array([edited]))[0]), prints[following]
        want[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016x}", f"{new:016x}", 1 - (own ^ new).bit_count() / 64, 1 - (own ^ after).bit_count() / 64)] += 1
    assert Counter(got) == want
    assert fingerprint.edited_fingerprints(empty).count() == 0


@pytest.mark.parametrize("radius, tile", [(1, 2048), (3, 2048), (3, 4)])
def test_near_pairs(spark, radius, tile, monkeypatch):
    monkeypatch.setattr(fingerprint, "TILE", tile)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base]
    near += [base[0] ^ 1 << i for i in range(40)]
    values = [v - (1 << 64) if v >> 63 else v for v in base + near + base[:3]]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "simhash long")
    got = Counter(tuple(r) for r in fingerprint.near_pairs(table, radius).collect())
    distinct = sorted(set(values))
    want = {(a, b, d) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= radius}
    assert got == Counter(want)
    assert fingerprint.near_pairs(table.limit(0), radius).count() == 0


def test_near_counts(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_simhash(r[1]) for r in corpus()]
    want = Counter((r[0], sum(0 < (a ^ b).bit_count() <= fingerprint.RADIUS for b in set(prints))) for r, a in zip(corpus(), prints))
    assert Counter((r["doc_id"], r["n_near"]) for r in fingerprint.op1_fingerprint(spark, str(tmp_path)).collect()) == want
    assert sum(n for _, n in want) > 0 and fingerprint.near_counts(empty).count() == 0
    with pytest.raises(ValueError):
        fingerprint.fingerprints(docs.withColumnRenamed("lang", "simhash"))


@pytest.mark.parametrize("few", [10_000, 0])
def test_mixing(docs, empty, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", few)
    rows = corpus()
    got = mixing.mix(docs, mixing.word_count("text")).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    taken = Counter()
    for r in got:
        assert 0 <= r["copies"] * r["size"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    for source, whole in sizes.items():
        target = next(r["target"] for r in got if r["source"] == source)
        times, reached = int(target // whole) if whole else 0, 1
        for r in rows:
            reached |= reached << len(words_of(r[1])) if r[3] == source else 0
        budget = round(target - times * whole)
        best = (reached & ((1 << (budget + 1)) - 1)).bit_length() - 1
        assert taken[source] == times * whole + best
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    assert {r["source"]: r["target"] for r in got} == pytest.approx(dict(zip(names, want)))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, mixing.word_count("text")).collect()))
    assert mixing.mix(empty, mixing.word_count("text")).count() == 0


CLASHES = ["col", "size", "mixed_copy", "mixed_id", "draw", "twin", "copies", "equals", "times", "time", "place", "row", "kept_id", "ident", "name", "component", "own_ident", "own_name", "own_text", "stats", "score", "hash", "at", "part", "simhash", "a.b"]


def clashing(docs):
    """docs with a column of each name that the stages use inside, telling the row."""
    return docs.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])


def unspoiled(out, docs):
    assert out.columns == [*docs.columns, *CLASHES]
    for r in out.collect():
        assert all(r[c] == f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for c in CLASHES)


def test_mix_takes_equal_rows_no_more_than_it_says(docs):
    more = clashing(docs.unionByName(docs.filter("doc_id in (7, 8, 9)")).unionByName(docs.filter("doc_id = 7")))
    out = mixing.apply_mix(more)
    unspoiled(out, docs)
    want = Counter()
    for r in mixing.mix(more, mixing.word_count("text")).collect():
        want[r["doc_id"], r["draw"]] += r["copies"]
    draw = mixing.draws_of(17)[0]
    assert Counter((r[0], r[1]) for r in out.select("doc_id", draw).collect()) == +want


def test_targets_reshare_until_none_is_above():
    found = mixing.targets([10, 10, 100], [5, 2, 1], 180)
    assert found == pytest.approx([20, 20, 140])


def test_knapsack_meets_reachable_sums():
    rng = random.Random(1)
    for _ in range(50):
        sizes = np.array(sorted(rng.sample(range(1, 40), 5)))
        counts = np.array([rng.randint(0, 3) for _ in sizes])
        budget = rng.randint(1, 120)
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist()):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        taken = mixing.knapsack(sizes, counts, budget)
        assert (taken <= counts).all() and int((taken * sizes).sum()) == max(x for x in sums if x <= budget)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.pack(docs, size=256).collect():
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in {(r[0], r[1]) for r in corpus()}:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want = Counter()
        for piece in got[doc_id]:
            part = np.array(ids[piece["start"] : piece["start"] + piece["length"]], "<u4")
            assert piece["doc_tokens"] == len(ids) and piece["ids_crc32"] == zlib.crc32(part.tobytes())
            want.update(range(piece["start"], piece["start"] + piece["length"]))
        assert set(want) == set(range(len(ids))) and len(set(want.values())) == 1
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["a  b", " lead", "tail ", "a\n b", "a \n\nb c", "x  y", "it's 12 <|endoftext|> z", "café 中文 !!!", "w　 q"])
def test_words_encode_as_whole_texts(text):
    encoder = packing.Encoder(packing.tokenizer_path())
    assert encoder(text) == encoder.whole(text)


def test_cuts_are_least():
    rng = random.Random(2)
    for _ in range(40):
        pos = [0]
        while len(pos) < 9:
            pos.append(pos[-1] + rng.randint(1, 6))
        penalty = [0.0] + [float(rng.randint(0, 3)) for _ in pos[1:]]
        penalty[-1] = 0.0

        def cost(ends):
            return sum(10 - (pos[b] - pos[a]) + penalty[b] for a, b in zip([0, *ends], ends)) if all(pos[b] - pos[a] <= 10 for a, b in zip([0, *ends], ends)) else 1e9

        found = [pos.index(p) for p in packing.cuts(pos, penalty, 10)]
        options = [[i for i in range(1, len(pos)) if m >> i & 1] for m in range(0, 1 << len(pos), 2)]
        best = min(cost(o) for o in options if pos[-1] - pos[o[-1] if o else 0] <= 10)
        assert cost(found) == best and pos[-1] - pos[found[-1] if found else 0] <= 10


def plain_quality(rows, labels, got):
    """Log densities by inverse and determinant of each class's shrunk covariance."""
    x = {r[0]: quality.statistics(pa.array([r[1]]))[0] for r in rows}
    known = [(r["doc_id"], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in x]
    parts = {k: np.array([x[i] for i, q in known if q == k]) for k in (0, 1)}
    scatter = {k: (p - p.mean(axis=0)).T @ (p - p.mean(axis=0)) for k, p in parts.items()}
    pooled = sum(scatter.values()) / len(known) + 1e-6 * np.eye(quality.DIMS)
    pooled = (1 - quality.GAMMA) * pooled + quality.GAMMA * np.diag(np.diag(pooled))
    for r in got:
        density = {}
        for k, p in parts.items():
            own = (1 - quality.ALPHA) * scatter[k] / len(p) + quality.ALPHA * pooled
            z = x[r["doc_id"]] - p.mean(axis=0)
            density[k] = np.log(len(p) / len(known)) - np.linalg.slogdet(own)[1] / 2 - z @ np.linalg.inv(own) @ z / 2
        want = 1 / (1 + np.exp(np.clip((density[0] - density[1]) / quality.HEAT, -40, 40)))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)


def test_quality(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + ("###" if i % 2 else "") for _ in range(40)), "en", "s", 0) for i in range(300)]
    many = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(many, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == 1 - r["doc_id"] % 2 for r in held]) > 0.98
    assert quality.keep_good(many, labels).count() == sum(r["predicted"] for r in got)
    plain_quality(rows, labels.filter("quality in (0, 1) and doc_id is not null").collect(), got)
    unspoiled(quality.keep_good(clashing(docs), labels), docs)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == len(corpus())
    assert quality.classify(empty, labels).count() == 0


def test_personal(spark, docs, empty):
    texts = ["mail a.b@c.de, 1.2.3.4.5.6.7.8 and 300.1.1.1", "+1 (212) 555-0100 or 4111 1111 1111 1111", "@x.y a@b c@d.e@f.gh", 'token = "abcdef0123456789abcd"', None, "", "9" * 30, "+12 345 6789012345678901"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in personal.personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[0][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [1, 2, 0, 0]
    assert [got[1][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [0, 0, 1, 1]
    assert got[2]["n_email"] == 1 and got[4]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(r["n_spans"] == len([s for s in r["spans"].split(",") if s]) >= sum(r[f"n_{k}"] for k in ("email", "ip", "card", "phone")) for r in got.values())
    import re

    plain = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("1234567890.@+-a ()z" if rng.random() < 0.8 else "0.5") for _ in range(rng.randint(0, 60)))
        want = []
        for kind, pattern in plain.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {0: True, 1: all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 2: 12 <= len(digits) <= 19 and personal.luhn(digits), 3: 9 <= len(digits) <= 15}[kind]
                want += [(m.start(), kind, m.end())] * ok
        assert personal.base_spans(text) == sorted(want), text
    unspoiled(personal.redact(clashing(docs)), docs)
    masked = {r["doc_id"]: r["text"] for r in personal.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert masked[1] == "<phone> or <card>" and masked[4] is None
    assert personal.personal_data(docs).count() == len(corpus()) and personal.personal_data(empty).count() == 0


def test_long_secrets_are_found_to_their_end():
    text = "key=" + "a1B2" * 500 + " end"
    assert (4, 4, 2004) in personal.candidates(text)
    spelled = "a" * 500 + " at " + "b" * 500 + " dot " + " dot ".join(["c" * 100] * 9)
    assert (0, 0, len(spelled)) in personal.candidates(spelled)


def test_added_spans_overlap_nothing():
    rng = random.Random(9)
    span = lambda: ((s := rng.randint(0, 40)), rng.randint(0, 4), s + rng.randint(1, 6))
    for _ in range(500):
        base = sorted(span() for _ in range(rng.randint(0, 5)))
        more = sorted((*span(), rng.choice("ab")) for _ in range(rng.randint(0, 9)))
        want = list(base)
        for s, k, e, key in more:
            if key == "a" and not any(s < f and b < e for b, _, f in want):
                want.append((s, k, e))
        assert personal.all_spans(base, more, {(k, "a"): 0.9 for k in range(5)}) == sorted(want)


def test_reliabilities_by_hand():
    """EM in plain loops: labelers independent given the class, priors and rates with the same pseudo-counts."""
    rng = random.Random(2)
    patterns = {(k, "".join(rng.choice("yn-") for _ in range(5)) + "2s"): rng.randint(1, 90) for k in (0, 3, 3, 4, 4) for _ in range(4)}
    p = {k: (k[1][:5].count("y") + 1) / (k[1][:5].count("y") + k[1][:5].count("n") + 2) for k in patterns}
    for _ in range(50):
        rate = {}
        for j in range(5):
            for label in (0, 1):
                chance = lambda k, label=label: p[k] if label else 1 - p[k]
                said = sum(n * chance(k) for k, n in patterns.items() if k[1][j] != "-")
                yes = sum(n * chance(k) for k, n in patterns.items() if k[1][j] == "y")
                no = sum(n * chance(k) for k, n in patterns.items() if k[1][j] == "n")
                rate[j, label] = {"y": (yes + (4 if label else 1)) / (said + 5), "n": (no + (1 if label else 4)) / (said + 5), "-": 1.0}
        new = {}
        for k in patterns:
            own = {x: n for x, n in patterns.items() if x[0] == k[0]}
            prior = (sum(n * p[x] for x, n in own.items()) + 2) / (sum(own.values()) + 4)
            true, false = prior, 1 - prior
            for j in range(5):
                true, false = true * rate[j, 1][k[1][j]], false * rate[j, 0][k[1][j]]
            new[k] = true / (true + false)
        p = new
    found = personal.estimate(patterns)
    assert found == pytest.approx(p, abs=1e-6)


def test_reliabilities_tell_labelers_apart():
    patterns = {(3, "yy-yy2s"): 90, (3, "nn-nn0j"): 80, (3, "y--yy2s"): 10, (3, "n--ny0j"): 10}
    found = personal.train(patterns)
    assert found[(3, "yy-yy2s")] > 0.5 > found[(3, "nn-nn0j")]


def test_archive(spark, tmp_path):
    rng = random.Random(8)
    big = "".join(rng.choice("abcé") for _ in range(300_000))
    rows = [(1, "http://a/é", big), (2, "u", big), (9, "u", big), (3, None, "x" * 999), (4, "v", "x" * 999), (5, "v", "y" * 1000), (6, "v", "y" * 1000), (7, "v", None), (8, "v", ""), (None, "w", "z\r\n\r\nWARC/1.1\r\n" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    manifest = archive.write(archive.decide(pages, "page_id", "html", "url"), folder)
    table = archive.read(spark, manifest, folder).collect()
    by = defaultdict(list)
    for r in table:
        by[r["record_id"]].append(r)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    revisits = {1: 9, 2: 9, 5: 6}
    for ident, chunks in by.items():
        chunks.sort(key=lambda r: r["chunk_no"])
        assert [c["chunk_no"] for c in chunks] == list(range(len(chunks))) and [c["last"] for c in chunks] == [False] * (len(chunks) - 1) + [True]
        assert chunks[-1]["declared_digest"] == hashlib.sha1(texts[ident]).hexdigest() and chunks[-1]["declared_bytes"] == len(texts[ident])
        if ident in revisits:
            assert chunks[0]["record_type"] == "revisit" and chunks[0]["refers_to"] == revisits[ident]
        else:
            assert b"".join(c["chunk"] for c in chunks) == texts[ident] and chunks[0]["record_type"] == "response"
            done = b""
            for c in chunks:
                assert len(c["chunk"]) <= archive.CHUNK
                done += c["chunk"]
                assert c["digest_so_far"] == hashlib.sha1(done).hexdigest()
    assert set(by) == set(texts)
    payloads = archive.read(spark, manifest, folder, payloads=False)
    assert payloads.rdd.getNumPartitions() > 1 and payloads.filter("last").count() == len(rows)
    none = archive.write(archive.decide(pages.limit(0), "page_id", "html", "url"), f"file://{tmp_path}/none")
    assert archive.read(spark, none, f"file://{tmp_path}/none").count() == 0


def test_archives_with_other_payloads_are_refused():
    import io

    good = archive.head(1, "u", "response", None, 3, hashlib.sha1(b"abc").hexdigest())
    assert [r[4] for r in archive.chunks_of(io.BytesIO(good + b"abc\r\n\r\n"))] == [b"abc"]
    with pytest.raises(ValueError):
        list(archive.chunks_of(io.BytesIO(good + b"abd\r\n\r\n")))
    with pytest.raises(EOFError):
        list(archive.chunks_of(io.BytesIO(good + b"a")))


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def components_of(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def near_corpus(n=150):
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base) if i % 3 else [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words), "en", "s", 0))
    return rows


@pytest.mark.parametrize("hot", [32, 4])
def test_near_duplicates(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(nearjoin, "HOT", hot)
    monkeypatch.setattr(nearjoin, "CHUNK", 16)
    monkeypatch.setattr(nearjoin, "SPREAD", 5)
    for rows in (corpus(), near_corpus()):
        got = Counter(map(tuple, nearjoin.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))
        assert got == components_of(rows)


def test_near_duplicates_of_nothing(empty):
    assert nearjoin.near_duplicates(empty).count() == 0
    links, members = nearjoin.near_links(empty)
    assert links.count() == 0 and members.count() == 0


def chained_corpus():
    """Texts that share long passages in a chain: lists of one cluster that only neighbours have in common."""
    rng = random.Random(12)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(6)]
    rows = []
    for k in range(5):
        for i in range(12):
            words = passages[k] + passages[k + 1]
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((12 * k + i, " ".join(words[rng.randint(0, 3) :]), "en", "s", 0))
    return rows


@pytest.mark.parametrize("hot, rows", [(32, near_corpus()), (4, near_corpus()), (4, chained_corpus()), (4, corpus())])
def test_all_links(spark, hot, rows, monkeypatch):
    monkeypatch.setattr(nearjoin, "HOT", hot)
    monkeypatch.setattr(nearjoin, "CHUNK", 8)
    links, members = nearjoin.near_links(spark.createDataFrame(rows, SCHEMA).repartition(3))
    members = members.collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in members) == Counter((r[0], len(shingles(r[1]))) for r in rows)
    texts = {r[0]: shingles(r[1]) for r in rows}
    classes = {r["class_id"]: texts[r["doc_id"]] for r in members if r["n_shingles"]}
    assert len(set(classes.values())) == len(classes)
    ids = sorted(classes)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(classes[a] & classes[b]) >= 80 * len(classes[a] | classes[b])}
    assert Counter(map(tuple, links.collect())) == Counter(want)
    assert Counter(map(tuple, nearjoin.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == components_of(rows)


def test_chosen_prefixes_hold_the_matches():
    rng = random.Random(3)
    for _ in range(100):
        n = rng.randint(1, 200)
        counts = np.array(sorted(rng.randint(2, 50) for _ in range(rng.randint(nearjoin.overlap(n), n))))
        match, length = nearjoin.choose(n, counts)
        assert 1 <= match <= max(1, nearjoin.overlap(n)) and length == max(0, n - nearjoin.overlap(n) + match - (n - len(counts)))


def test_kernel_by_listing_subsequences():
    rng = random.Random(3)
    units = ["".join(rng.choice("abcé0@ж一") for _ in range(rng.randint(1, 12))) for _ in range(40)] + ["blorgon", "blxorgon", "bl0rgon"]
    marks = units[:15] + ["blorgon", "a"]

    def subsequences(unit):
        letters = [int(c) for c in toxicity.codes([unit])[0] if c]
        out = Counter()
        for i in range(len(letters)):
            for j in range(i + 1, len(letters)):
                for k in range(j + 1, min(len(letters), i + toxicity.SPAN)):
                    out[letters[i], letters[j], letters[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def plain(u, v):
        a, b = subsequences(u), subsequences(v)
        norm = lambda x: max(sum(w * w for w in x.values()), 1e-6) ** 0.5
        value = sum(w * b[s] for s, w in a.items()) / norm(a) / norm(b)
        return value**toxicity.SHARP if value >= toxicity.FLOOR else 0.0

    found = toxicity.Kernel(list(dict.fromkeys(marks)))
    values = found(units)
    for i, u in enumerate(units):
        for j, v in enumerate(found.landmarks):
            assert values[i, j] == pytest.approx(plain(u, v), abs=2e-4)
    assert plain("blorgon", "bl0rgon") == pytest.approx(1) and 0 < plain("blorgon", "blxorgon") < 1


def test_letters_of_other_scripts_differ():
    one, other = toxicity.codes(["блор", "жщыэ"])
    assert (one != other).any() and len(set(one.tolist())) > 4


def test_toxicity_counts_copies_once(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("bdfghjkqvxyz") for _ in range(8)) for _ in range(200)]
    text = ". ".join(" ".join(words[i : i + 8]) for i in range(0, 200, 8))
    docs = spark.createDataFrame([(i, text if i % 2 else f"{' '.join(rng.sample(words, 9))} river {i}", "en", "s", 0) for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    assert toxicity._marked(toxicity._sample(docs, labels)) == []


def test_toxicity_learns_other_scripts_and_the_ends_of_long_units(spark):
    front = "riverstonewindowgardenpapermusicwintersilverautumnvalley"
    docs, labels, plain = toxic_table(spark, ["блоргон", front + "zquimpfx"], 60)
    model = toxicity.train(docs, labels)
    found = model.score(model.scorer()([plain, f"{plain} привет", f"{plain} блоргон", f"{plain} {front}zquimpfx"]))
    assert max(found[:2]) < 0.5 < min(found[2:])


def test_toxicity(spark, docs, empty):
    rng = random.Random(5)
    clean = ["river", "stone", "window", "garden", "paper", "music", "winter", "silver"]
    rows = []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(60)]
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["blorgon", "snarfle", "b.l.o.r.g.o.n"])
        rows.append((i, " ".join(words), "en", "s", 0))
    many = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(many, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    model = toxicity.train(many, labels)
    score = lambda t: model.score(model.scorer()([t]))[0]
    plain = " ".join(clean * 4)
    assert score(plain + " blor-gon snar_fle blxorgon") > 0.5 > score(plain) and score(plain + " b l o r g o n s n a r f l e") > score(plain)
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(empty, labels).count() == 0


def toxic_table(spark, insults, times, commons=0, seed=7):
    """Short texts, half of them toxic: each of the insults in so many documents, and more with one common insult."""
    rng = random.Random(seed)
    clean = ["river", "stone", "window", "garden", "paper", "music", "winter", "silver"]
    found = [w for w in insults for _ in range(times)] + ["blorgon"] * commons
    texts = [(" ".join([rng.choice(clean) for _ in range(12)] + [w]), 1) for w in found] + [(" ".join(rng.choice(clean) for _ in range(13)), 0) for _ in found]
    ids = [i for i in range(3 * len(texts)) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, (t, _) in zip(ids, texts)], SCHEMA)
    return docs, spark.createDataFrame([(i, 1, k) for i, (_, k) in zip(ids, texts)], "doc_id long, quality int, toxic int"), " ".join(clean)


def test_toxicity_learns_rare_insults_of_large_samples(spark):
    docs, labels, plain = toxic_table(spark, ["zquimpf"], 10, 6000)
    model = toxicity.train(docs, labels)
    found = model.score(model.scorer()([plain, plain + " zquimpf", plain + " blorgon"]))
    assert found[0] < 0.5 < min(found[1:])


def test_toxicity_learns_all_marked_units(spark):
    rng = random.Random(11)
    insults = ["".join(rng.choice("bdfghjkqvxyz") for _ in range(8)) for _ in range(150)]
    docs, labels, plain = toxic_table(spark, insults, 12)
    model = toxicity.train(docs, labels)
    found = model.score(model.scorer()([plain] + [f"{plain} {w}" for w in insults]))
    assert found[0] < 0.5 < min(found[1:])


def test_toxicity_sees_insults_within_long_units(spark):
    docs, labels, plain = toxic_table(spark, ["blorgon", "snarfle"], 200)
    model = toxicity.train(docs, labels)
    front = "riverstonewindowgardenpapermusicwintersilver"
    hidden = [" ".join(front + "blorgon"), "-".join(front + "blorgon"), "river-stone-window-garden-paper-music-blorgon", "river/snarfle/stone", front + "snarfle" + front, " ".join("garden" + "snarfle")]
    found = model.score(model.scorer()([plain, plain + " " + front, plain + " " + " ".join(front)] + [f"{plain} {w}" for w in hidden]))
    assert max(found[:3]) < 0.5 < min(found[3:])


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[50:60] = x[49]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(20, x[7].tolist()), (1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [1.0, None]), (None, x[3].tolist()), (1080, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = defaultdict(list)
    for r in sorted(neighbours.nearest(table, lambda i: i % 20 == 0, k=7).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for a, (i, v) in enumerate(valid):
        if i % 20 == 0 and i != 20:
            want = sorted(((-float(v @ w), j) for b, (j, w) in enumerate(valid) if b != a))[:7]
            assert got[i] == [(j, round(-s, 9)) for s, j in want]
    assert len(got[20]) == 14
    assert neighbours.nearest(table.limit(0), lambda i: i % 20 == 0).count() == 0


def test_tiles_bound_the_error():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(30, 16)), rng.normal(size=(40, 16)) * 5
    rough, slack = neighbours.tile(neighbours.quantise(q), neighbours.quantise(c))
    assert (np.abs(rough - q @ c.T) <= slack).all()


@pytest.mark.parametrize("window", [2, 5, 35])
def test_substrings(docs, empty, window):
    rows = corpus()
    counts = Counter()
    for r in rows:
        words = words_of(r[1])
        counts.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    want = Counter()
    for r in rows:
        words = words_of(r[1])
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        want[(r[0], len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    assert Counter(map(tuple, substrings.remove_repeated(docs, window).collect())) == want
    assert substrings.remove_repeated(empty, window).count() == 0


def test_sliding():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 27):
        assert blocks.sliding(x, width, np.minimum, blocks.TOP).tolist() == [min(x[i : i + width]) for i in range(50)]


PIPELINE_LABELS = [(i, int(i % 5 > 0), 0) for i in range(70)]


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage's rows, on repeated ids, repeated rows and columns that clash with the stages' own names."""
    import corpus_pipeline

    spark.createDataFrame(PIPELINE_LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    near = next(r[1] for r in corpus() if len(words_of(r[1])) > 100)
    more = [(5, near + " one", "en", "s", 0), (3, near, "en", "s", 0), (5, "a second text of this id, mail a.b@c.de", "en", "s", 0), (None, "", "en", "s", 0)] * 2
    whole = clashing(docs.unionByName(spark.createDataFrame(more, SCHEMA)))
    held = whole
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        before = [tuple(r) for r in held.collect()]
        rows = [tuple(r) for r in after.collect()]
        if name != "packing":
            unspoiled(after, docs)
        if name == "quality":
            scores = {r["doc_id"]: r for r in quality.classify(held, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
            assert Counter(rows) <= Counter(before) and len(rows) == quality.classify(held, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter("predicted = 1").count() and scores
        if name == "near_duplicates":
            assert sorted(map(str, rows)) == sorted(map(str, one_of_each(before, {r[0]: r[1] for r in held.select("text", F.xxhash64("text")).distinct().collect()})))
        if name == "personal":
            assert Counter((r[0], *r[5:]) for r in rows) == Counter((r[0], *r[5:]) for r in before)
            assert all((r[1] is None) == (r[4] is None) and (r[1] is None or len(r[1]) == r[4]) for r in rows) and not any("@c.de" in (r[1] or "") for r in rows)
        if name == "mixing":
            taken = Counter()
            for r in mixing.mix(held, mixing.word_count("text")).collect():
                taken[r["doc_id"], r["size"]] += r["copies"]
            assert Counter((r[0], len(words_of(r[1]))) for r in rows) == +taken and set(rows) <= set(before)
        if name == "packing":
            assert Counter((r[0], r[4]) for r in rows if r[1] == 0) == Counter((r[0], r[4]) for r in map(tuple, packing.pack(held).collect()) if r[1] == 0)
            assert sum(r[1] == 0 for r in rows) == len(before)
        held = after
    assert held.count() > 0


def one_of_each(rows, names):
    """Of each component the row of least id, then text hash; of equal rows one; all rows without words."""
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for r, g in zip(rows, group):
        key = (r[0] is None, r[0] or 0, names[r[1]])
        if g not in best or key < best[g][0]:
            best[g] = (key, r)
    return [r for _, r in best.values()]


def test_pipeline_of_nothing(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(PIPELINE_LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_staged_tables_leave_no_names(spark, docs):
    substrings.remove_repeated(docs).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ctxloom")]
