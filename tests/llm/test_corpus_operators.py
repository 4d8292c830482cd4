"""The corpus operators against brute force on small tables, with the odd rows: null, empty, repeated, very long."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from surfaceloom.llm import jaccard, mixing, neardup, packing, secrets, sharding, spans, substrings, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra=True):
    """doc_id, text and source, with columns whose names operators use themselves."""
    made = [(i, t, f"s{n % 4}" if n % 7 else None, n, "x") for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, size long, class string").repartition(3)
    return df if extra else df.select("doc_id", "text")


def prose(seed, docs=40, words=120, vocabulary=900):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(vocabulary)]
    out = []
    for i in range(docs):
        text = ""
        for _ in range(rng.randint(0, words)):
            text += rng.choice(vocab) + rng.choice([" ", " ", " ", ". ", "\n", ", "])
        out.append((i, text))
    return out


def edits(seed, families=14, copies=7):
    """Families of texts that drift apart a few words at a time, with exact copies."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    out = []
    for _ in range(families):
        text = rng.choices(vocab, k=rng.choice([3, 4, 5, 6, 8, 12, 20, 40, 90, 250]))
        for _ in range(copies):
            out.append((1000 + len(out), " ".join(text)))
            for _ in range(rng.choice([0, 1, 1, 2, 1 + len(text) // 40])):
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(vocab)
    return out


ODD = [(5001, ""), (5002, None), (5003, " \n\t "), (5004, "one"), (5005, "ONE"), (5006, "x " * 800), (5007, "x " * 4), (5008, "é" * 300), (5009, "a" * 1200)]


# ---- 1 packing
def unpacked(rows):
    docs, lengths = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id][r.start] = (r.length, r.ids_crc32, r.doc_tokens)
        lengths[r.sequence_id].append((r.offset, r.length))
    return docs, lengths


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*prose(1), *ODD, (6000, "A long sentence without an end " * 900), (6001, "double  blanks\n and\ttabs  "), (6002, " <|endoftext|> it's")]
    docs, lengths = unpacked(packing.pack(frame(spark, rows)).collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, (length, crc, tokens) in sorted(docs[i].items()):
            assert start == at and tokens == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    padding = total = 0
    for pieces in lengths.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SIZE
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
        total += at
    assert padding < 0.1 * total  # three partitions, so three ends


def test_packing_odd_tables(spark, monkeypatch):
    assert packing.pack(frame(spark, [(1, "x")]).where("false")).collect() == []
    rows = [(None, "no id here"), (None, "nor here"), (7, "same row"), (7, "same row"), (7, None)]
    got = packing.pack(frame(spark, rows).coalesce(1)).collect()
    size = lambda t: len(packing.encoder().encode(t))
    assert sorted(str((r.doc_id, r.doc_tokens)) for r in got) == sorted(str((i, size(t))) for i, t in rows) and sum(r.length for r in got) == sum(size(t) for _, t in rows)


def test_packing_goes_on_beyond_the_horizon(spark, monkeypatch):
    """A document of many horizons, planned in parts, is cut as if planned in one go."""
    rows = [*prose(4, 12, 400), (500, "".join(t for _, t in prose(5, 60, 900))), *((600 + i, t) for i, t in prose(6, 12, 400))]
    made = []
    for horizon in (2048, 1 << 40):
        monkeypatch.setattr(packing, "HORIZON", horizon)
        stream, out = packing.Stream(packing.encoder(), 0, packing.SIZE), []
        for i, t in rows:
            out += stream.add([(i, stream.encoder.encode(t))])
        made.append(out + list(stream.close()))
    assert made[0] == made[1] and max(r[4] for r in made[0]) > 8 * 2048


def test_packing_plan_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        size = 64
        cuts = [0]
        while len(cuts) < 12:
            cuts.append(cuts[-1] + rng.randint(1, 40))
        prices = [rng.choice([0, 4, 24]) for _ in cuts]
        pad = lambda n: size - n if n & (n - 1) else 0
        best = {0: 0}
        for j in range(1, len(cuts)):  # powers of two below 32 are not looked for
            spans = [(i, cuts[j] - cuts[i]) for i in range(j) if cuts[j] - cuts[i] <= size]
            best[j] = min(best[i] + (pad(n) if n >= 32 else size - n) for i, n in spans) + packing.SEQUENCE + prices[j]
        plan = packing.Plan(size)
        plan.extend(np.array(cuts[1:5]), np.array(prices[1:5]))
        found = plan.settled()
        plan.extend(np.array(cuts[5:]), np.array(prices[5:]))
        found += plan.finish()
        cost, at = 0, 0
        for c in found:
            n = c - at
            assert 0 < n <= size
            cost += pad(n) + packing.SEQUENCE + prices[cuts.index(c)]
            at = c
        assert at == cuts[-1] and cost <= best[len(cuts) - 1]


# ---- 2 and 6 embeddings
def vectors(spark, x, more=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(more)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


BAD_VECTORS = [(9000, None), (9001, [float("nan")] + [0.1] * 7), (9002, [float("inf")] + [0.1] * 7), (9003, [None] + [0.1] * 7), (9004, [0.1] * 3), (None, [0.5] * 8)]


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((700, 8)) * rng.uniform(0.2, 3, (700, 1))).astype(np.float32)
    x[50:90] = x[0]  # ties
    got = collections.defaultdict(list)
    for r in topk.search(vectors(spark, x, BAD_VECTORS)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    z = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    assert set(got) == set(range(0, 700, 100))
    for query in got:
        order = sorted((int(-(z[query] @ z[i])), i) for i in range(700) if i != query)[:10]
        assert sorted(got[query]) == [(n + 1, i, -s) for n, (s, i) in enumerate(order)]
    assert topk.search(vectors(spark, x[:0])).collect() == []
    assert len(topk.search(vectors(spark, x[:4])).collect()) == 3


def test_embedding_neardup(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)  # so that buckets are cut into tiles
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 8))
    x = np.concatenate([centres + rng.standard_normal((30, 8)) * s for s in (0, 0.05, 0.1, 0.2)] + [centres[:1]] * 40 + [np.zeros((2, 8))]).astype(np.float32)
    rows = {r.vec_id: r for r in neardup.near(vectors(spark, x, BAD_VECTORS[:5])).collect()}
    d = x.astype(np.float64)
    norm = np.linalg.norm(d, axis=1, keepdims=True)
    u = d / np.where(norm > 0, norm, 1)
    near = (u @ u.T >= 0.9) & (norm > 0) & (norm > 0).T
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label, len(x)).min(1))
        if (new == label).all():
            break
        label = new
    found, true = sum(r.n_links for r in rows.values()), int(near.sum())
    assert 0.97 * true <= found <= true
    assert sum(rows[i].component_id == label[i] for i in range(len(x))) >= 0.97 * len(x)
    assert all(rows[i].n_links <= near[i].sum() for i in range(len(x)))
    assert all(rows[i].n_links == 0 and rows[i].kept for i in range(9000, 9005))
    assert rows[0].n_links >= 40
    assert neardup.near(vectors(spark, x[:0])).collect() == []


def test_embeddings_that_share_an_id(spark):
    a, b, c = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6, [0.0, 0.0, 1.0] + [0.0] * 5
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (None, near(near(b))), (None, c), (None, near(c)), (7, near(near(c)))]
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in neardup.near(vectors(spark, [], rows)).collect())
    assert got == collections.Counter([(1, 1, 1), (5, 1, 1), (1, 2, 1), (6, 2, 1), (None, 2, 1), (None, 2, 7), (None, 2, 7), (7, 2, 7)])


# ---- 3 toxicity
INSULTS = ["grobian", "wurstkopf", "dumpling", "fishface"]


def toxic_corpus(n=260):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 60))
        bad = i % 4 == 0
        for w in rng.sample(INSULTS, 2) if bad else ():
            words.insert(rng.randrange(len(words)), rng.choice([w, w, w, w.capitalize() + "!", ".".join(w), w[:3] + "-" + w[3:]]))
        rows.append((i, " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs = frame(spark, [*rows, *ODD])
    model = toxicity.train(docs, spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(dict(labels)[i]) for i in held) >= 0.95 * len(held)
    value = dict(zip(words := ["wurstkopf", "w.u.r.s.t.k.o.p.f", "wurst-kopf", "wxurstkopf", "table"], model.strings(words), strict=True))
    assert min(value["wurstkopf"], value["w.u.r.s.t.k.o.p.f"], value["wurst-kopf"]) > 0 > value["table"]
    assert value["wxurstkopf"] > value["table"]
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.score == pytest.approx(0.01) for r in toxicity.score(docs, none).collect())


def test_training_takes_whole_texts(spark):
    long = "clean words here. " * 3000 + "such a grobian."
    docs = spark.createDataFrame([(i, long) for i in range(10)], "doc_id long, text string")
    got = toxicity.sample(docs, spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, toxic int"))
    assert got and all(x == (long, 1) for x in got)


def plain_value(model, string):
    """The machine's value of a string, an occurrence of a triple at a time."""
    count = collections.Counter()
    code = ["abcdefghijklmnopqrstuvwxyz".find(c.lower()) if c.isascii() else -1 for c in string]
    for a in range(len(code)):
        for b in range(a + 1, len(code)):
            for c in range(b + 1, min(len(code), a + toxicity.SPAN)):
                if min(code[a], code[b], code[c]) >= 0:
                    count[(code[a] * 26 + code[b]) * 26 + code[c]] += toxicity.DECAY ** (c - a + 1)
    norm = sum(w * w for w in count.values()) ** 0.5
    return sum(w * model.triples[t] for t, w in count.items()) / norm + model.bias if norm else model.bias


def plain_score(model, text):
    text = text or ""
    values = [max(plain_value(model, w) for w in toxicity.windows(t)) for t in toxicity.tokens(text)]
    runs = {}
    for sentence in re.split(r"[.!?]+(?=[ \t\n])|\n", text):
        words = [w for w in (re.sub("[^A-Za-z]", "", t).lower() for t in re.split(r"[ \t\n\r\x0b\x0c]+", sentence)) if w]
        for a in range(len(words)):
            for n in range(2, toxicity.RUN_WORDS + 1):
                joined = "".join(words[a : a + n])
                if a + n <= len(words) and 2 < len(joined) <= toxicity.RUN_LETTERS and (v := plain_value(model, joined)) > 0:
                    runs[joined] = v
    top = sorted([max(-1.0, v) for v in [*values, *runs.values(), -1.0, -1.0]], reverse=True)[:2]
    z = np.array([*top, np.log1p(sum(v > 0 for v in values) + len(runs)), 1.0]) @ model.curve
    return 1 / (1 + np.exp(-z))


def test_scores_are_those_of_a_plain_scorer(spark):
    rows, labels = toxic_corpus(160)
    model = toxicity.fit([(t, dict(labels)[i]) for i, t in rows])
    told = [*rows[:30], *ODD, (7000, "s n a r f"), (7001, "you snar ffle. Blib ber"), (7002, "s.n.a.r.f.f.l.e and\nmore"), (None, "no id"), (7003, "sn arf! fle")]
    got = {(r.doc_id, r.score) for r in toxicity.score(frame(spark, told), model).collect()}
    plain = {(i, plain_score(model, t)) for i, t in told}
    near = lambda x: sorted((str(i), round(float(v), 6)) for i, v in x)
    assert near(got) == near(plain)
    assert toxicity.score(frame(spark, told).where("false"), model).collect() == []
    with pytest.raises(ValueError):
        toxicity.score(frame(spark, told).withColumnRenamed("size", "score"), model, ("score",))


def test_kernel_is_the_gap_weighted_one():
    def weights(s):
        out = collections.Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    if (s[i] + s[j] + s[k]).isalpha():
                        out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = "banana.split", "bandana"
    wa, wb = weights(a), weights(b)
    dot = sum(v * wb[t] for t, v in wa.items()) / np.sqrt(sum(v * v for v in wa.values()) * sum(v * v for v in wb.values()))
    dense = toxicity.Strings.dense([a, b])
    assert dense[0] @ dense[1] == pytest.approx(dot, abs=1e-5)


# ---- 4 secrets
def base_spans(text):
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0, 20, 0), ("hex", "[0-9a-f]+", 0, 24, 0)]
    found = [(m.start(), n, k, m.end()) for n, (k, p, g, least, f) in enumerate(kinds) for m in re.finditer(p, text or "", f) if len(m[g]) >= least]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


SECRETS = [
    (1, "é token=abcdef password: 'hunter22' token=ab secret=token=abcdefg"),
    (2, "PASSWD='x1234567' api_key = abcdef APIKEY:zzzzzz toKen=abc"),
    (3, "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 12 + " AKIA" + "C" * 15),
    (4, "0123456789abcdef01234567 0123456789abcdef0123456 " + "f" * 60),
    (5, "ſecret=abcdef paſſwd=abcdef toKen=abcdef"),
    (6, "https://me:pass@h.example.com/ eyJabcdefghij.eyJabcdefghij.sig -----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"),
]


def test_secrets(spark):
    rows = [*SECRETS, *[(10 + i, SECRETS[0][1]) for i in range(5)], *ODD, *[(5003, " \n\t ")]]
    df = frame(spark, rows)
    ledger = secrets.scan(df)
    got = ledger.select("*").count()
    assert got == len({t or "" for _, t in rows})
    made = secrets.findings(df, ledger).select("path", "found").mapInArrow(secrets._digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").collect()
    assert len(made) == len(rows)
    for r in made:
        own = base_spans(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in own) for k in ("assign", "access", "hex"))
        assert set(own) <= set(r.spans.split(",") if r.spans else [])
    assert {s.split(":")[0] for s in next(r.spans for r in made if r.doc_id == 6).split(",")} >= {"url_login", "jwt", "private_key"}


def test_long_runs_are_read_once():
    import time

    text = "http://h/ " + "ab+c-9" * 170_000 + " 1https://u:p@x " + "eyJabcdefgh1" * 80_000 + ".eyJabcdefgh2.eyJabcdefgh3.sig"
    began = time.thread_time()
    found = {r.kind: secrets.spans_of(r, text) for r in secrets.RULES if r.front}
    assert time.thread_time() - began < 5
    assert [text[a:b] for a, b in found["url_login"]] == ["https://u:p@"] and [text[b - 4 : b] for _, b in found["jwt"]] == ["fgh3"]
    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choices(["://", "eyJ", "abcdefghij", ".", ":", "@", "a", "7", "-", " ", "/"], k=rng.randrange(14)))
        for rule in (r for r in secrets.RULES if r.front and any(h in text.lower() for h in r.hints)):
            assert secrets.spans_of(rule, text) == [m.span() for m in re.finditer(rule.pattern, text, rule.flags)], text


def test_secret_ledger_is_incremental(spark):
    one, two = frame(spark, SECRETS[:3]), frame(spark, [*SECRETS[:4], (99, SECRETS[0][1])])
    ledger = secrets.scan(one, None, secrets.BASE)
    later = secrets.scan(two, ledger, secrets.BASE)
    assert later.count() == 1  # the fourth text alone is new
    newer = (*secrets.BASE[1:], secrets.BASE[0]._replace(version=2))
    again = secrets.scan(two, ledger.unionByName(later), newer).collect()
    assert len(again) == 4 and {tuple(r.rules) for r in again} == {("assign/2",)}


def test_redaction(spark):
    got = {r.doc_id: r.text for r in secrets.redact(frame(spark, [*SECRETS, (7, None), (8, "clean")])).collect()}
    assert got[7] is None and got[8] == "clean"
    assert got[1] == "é [SECRET] [SECRET]' token=ab [SECRET]"
    assert all(not base_spans(got[i]) for i in (1, 2, 3, 4))


def test_redaction_where_rows_share_an_id(spark):
    key = "AKIA" + "A" * 16
    rows = [(1, f"one {key} tail"), (1, f"a longer start, {key}"), (1, None), (1, "clean words"), (None, f"{key} first"), (None, f"none {key}"), (None, None), (None, f"none {key}")]
    got = sorted((r.doc_id or -1, str(r.text)) for r in secrets.redact(frame(spark, rows)).collect())
    assert got == sorted((i or -1, str(t).replace(key, "[SECRET]")) for i, t in rows)


# ---- 5 Jaccard
def linked(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80)])
def test_jaccard(spark, n, num, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(jaccard, "BLOCK_QUERIES", 3)
    rows = [*edits(n), *ODD]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows), n, num, 100).collect()}
    assert got == linked(rows, n, num, 100)


def test_jaccard_empty(spark):
    assert jaccard.join(frame(spark, [(1, "a")]).where("false")).collect() == []


def test_jaccard_links_rows_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(words)), (None, " ".join(words[:54])), (9, " ".join(words[:48]))]
    got = jaccard.join(frame(spark, rows), 4, 85, 100).collect()  # 7 and 9 are linked by the row between them alone
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (7, 7), (9, 7)]


def test_a_bucket_of_many_lists_no_pairs_that_need_more(spark):
    levels = jaccard.Levels(80, 100)
    level = next(i for i, k in enumerate(levels.parts) if k >= 9)
    n = int(levels.bounds[level])
    other = min(n * 100 // 80, int(levels.bounds[level + 2]) - 1)
    needed = int(levels.parts[level] - 2 * levels.spare[level]) - (n + other) * 20 // 180
    assert needed >= 2
    sign = lambda i: i << 8 | level
    # 40 texts hold one signature all together, and each two of them as many more as they need, the last two one less
    held = [(sign(1), c, 40) for c in range(40)] + [(sign(100 + c // 2 * 50 + i), c, 2) for c in range(40) for i in range(needed - (c >= 38))]
    held += [(sign(9000 + i), c, 2) for c in (0, 2) for i in range(needed - 2)]  # with the common one it is one too few
    mixed = spark.createDataFrame([(s, c, n, c, c, 1, h) for s, c, h in held], "sign long, class long, n long, root long, grp long, members long, held long")
    pairs = jaccard.candidates(mixed, 80, 100)
    asks = {(r.grp, r["class"]) for r in jaccard.shared_enough(pairs, mixed).collect()}
    assert asks == {(c + 1, c) for c in range(0, 40, 2)}  # the last two have the common one to make it up
    assert pairs.count() <= 22 < 40 * 39 / 2


def test_only_groups_whose_union_allows_it_are_opened(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(jaccard, "SLICE", 1)
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    texts = spark.createDataFrame([(1, words(0, 40)), (2, words(30, 70)), (3, words(2, 42)), (4, words(50, 90)), (5, words(5, 75))], "class long, text string")
    members = spark.createDataFrame([(7, 1, 40), (7, 2, 40), (8, 4, 40)], "grp long, class long, n long")
    queries = spark.createDataFrame([(7, 3, 40), (7, 4, 40), (7, 5, 70), (8, 3, 40), (8, 2, 40), (8, 4, 40)], "grp long, class long, n long")
    union, want = {7: set(range(70)), 8: set(range(50, 90))}, set()
    ranges = {2: range(30, 70), 3: range(2, 42), 4: range(50, 90), 5: range(5, 75)}
    for grp, own, size in [tuple(r) for r in queries.collect()]:
        least = max(40, -(-80 * size // 100))
        if len(union[grp] & set(ranges[own])) * 180 >= 80 * (size + least):
            want.add((grp, own))
    assert want == {(7, 3), (7, 5), (8, 4)}
    assert {tuple(r) for r in jaccard.qualifying(members, queries, texts, 1, 80, 100).collect()} == want
    monkeypatch.setattr(jaccard, "SLICE", 4)  # a wider bound closes no more
    assert want <= {tuple(r) for r in jaccard.qualifying(members, queries, texts, 1, 80, 100).collect()}


def test_no_similar_pair_lacks_a_signature():
    levels, rng = jaccard.Levels(80, 100), np.random.default_rng(4)
    for size in (6, 7, 9, 15, 40, 133, 500):
        for _ in range(15):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            most = int((len(a) * 2) * 20 / 180)
            gone = rng.integers(0, most // 2 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both) and len(a) != both:
                sa, sb = (set(jaccard.signatures(x, np.array([0, len(x)]), levels)[0].tolist()) for x in (a, b))
                assert sa & sb


# ---- 7 sharding
def test_sharding(spark):
    rows = [*prose(7, 200), *ODD, (5001, ""), (None, "n" * 50), (None, "n" * 60), (7777, "z" * 9000)]
    got = sharding.assign(frame(spark, rows), 4000).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in got:
        size[r.shard] += r.bytes
        digest = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert r.shard == format(digest, "060b")[: r.depth]
    names = sorted(size)
    assert all(size[r.shard] == r.shard_bytes for r in got)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]))
    assert all(n <= 4000 or len({r.doc_id for r in got if r.shard == s}) == 1 for s, n in size.items())
    for r in got:  # a parent would not have fitted
        if r.depth:
            assert sum(x.bytes for x in got if x.shard.startswith(r.shard[:-1])) > 4000
    assert sharding.assign(frame(spark, rows).where("false"), 10).collect() == []
    assert {r.shard for r in sharding.assign(frame(spark, rows[:5]), 1 << 30).collect()} == {""}


# ---- 8 sentence spans
def spans_cut(rows, words=spans.WORDS, lone=spans.LONE):
    """Pieces of each text, and the numbers of those that go."""
    parts = {i: [x for x in re.findall(spans.SENTENCE, t or "") if x] for i, t in rows}
    seen, gone = {}, collections.defaultdict(set)
    for i in sorted(parts):
        keys = [x.strip(" \t\n\x0b\x0c\r") for x in parts[i]]
        count = [len(WORD.findall(k)) for k in keys]
        found = set()
        for k in range(len(keys)):
            found |= {(k, n) for n in range(spans.RUN, len(keys) - k + 1) if sum(count[k : k + n]) >= words and (n == spans.RUN or sum(count[k : k + n - 1]) < words)}
            found |= {(k + 1 - n, n) for n in range(spans.RUN, k + 2) if sum(count[k + 1 - n : k + 1]) >= words and (n == spans.RUN or sum(count[k + 2 - n : k + 1]) < words)}
            if lone and count[k] >= lone:
                found.add((k, 1))
        for k, n in sorted(found):
            if seen.setdefault(tuple(keys[k : k + n]), (i, k)) != (i, k):
                gone[i].update(range(k, k + n))
    return parts, gone


@pytest.mark.parametrize("words,lone", [(12, 40), (0, 0), (5, 6)])
def test_sentence_spans(spark, words, lone):
    rng = random.Random(8)
    passage = " ".join(" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=9)) + "." for _ in range(4))
    short = "".join(" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=4)) + rng.choice([".\n", "! ", "... "]) for _ in range(13))  # 52 words in short sentences
    rows = [(i, t + f" End{i}. " + (passage if i % 9 == 3 else "") + (f"{i} more.\n\n{short}After {i}" if i % 7 == 2 else "")) for i, t in prose(8, 30)]
    rows += [*ODD, (6000, passage), (6001, passage), (6001, passage), (6002, "...lead. Same line  here? \n\n3.14 is\nall."), (6003, "\n\n .x"), (6004, f"  {short}"), (6005, "é. " * 40)]
    got = {r.doc_id: r for r in spans.dedup(frame(spark, rows), words, lone).collect()}
    parts, gone = spans_cut(rows, words, lone)
    for i, t in dict(rows).items():
        assert got[i].n_sentences == (len(parts[i]) if (t or "").strip(" \t\n") else 0) and got[i].n_removed == len(gone[i]), i
        assert got[i].kept == "".join(x for k, x in enumerate(parts[i]) if k not in gone[i])
    if words == 12:
        assert got[6000].n_removed == 4 and got[3].n_removed == 0 and got[12].n_removed == 4 and got[2].n_removed == 0 and got[9].n_removed >= 12
    assert all(got[i].kept == (t or "") for i, t in rows if not got[i].n_removed)
    assert spans.dedup(frame(spark, rows).where("false")).collect() == []


def test_sentence_spans_where_rows_share_an_id(spark):
    said = lambda n: " ".join(f"w{n}x{k}" for k in range(8)) + "."
    a, b, c = (f"{said(n)} {said(n + 1)}" for n in (0, 10, 20))
    rows = [(1, a), (1, b), (2, f"{a} {said(50)}"), (None, c), (None, f"{said(60)} {said(61)} {c}"), (None, f"{c} {said(70)}"), (3, c), (3, c)]
    got = spans.dedup(frame(spark, rows)).collect()
    kept = collections.Counter(s.strip() for r in got for s in re.findall(spans.SENTENCE, r.kept) if s)
    assert len(got) == len(rows) and kept == collections.Counter(said(n) for n in (0, 1, 10, 11, 20, 21, 50, 60, 61, 70))


# ---- 9 substrings
def cut(rows):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if seen.setdefault(raw[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 700)
    rng = random.Random(9)
    source = "".join(rng.choices("abcdef éß", k=2500))
    rows = []
    for i in range(40):
        a, c = rng.randrange(1500), rng.randrange(1500)
        rows.append((i, rng.choice(["", "q" * rng.randrange(5)]) + source[a : a + rng.randrange(60, 500)] + rng.choice(["", "z"]) + source[c : c + rng.randrange(90, 140)]))
    rows += [(100 + n, t) for n, t in enumerate(["a" * 99, "a" * 100, "a" * 101, "ab" * 300, "abc" * 77, "a" * 70 + "b" + "a" * 400, ("x" * 40 + "y") * 30, source + source])]
    rows += ODD
    for batches, hot, some in ((1, 4096, 4096), (2, 3, 16), (5, 4096, 7)):
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "SOME", some)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup(frame(spark, [*rows, rows[5]]), batches).collect()}
        assert got == cut(rows)
    assert substrings.dedup(frame(spark, rows).where("false")).collect() == []


def test_substrings_where_rows_share_an_id(spark):
    rng = random.Random(91)
    some = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shared, own, tails = some(400), some(500), [f"{n}{some(148)}{n}" for n in range(6)]
    rows = [(None, shared + tails[0]), (None, shared), (None, shared + tails[1]), (None, tails[2]), (4, shared + tails[3]), (4, own), (4, "short"), (9, tails[4] + shared), (9, own[:300] + tails[5])]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in substrings.dedup(frame(spark, rows)).collect()]
    assert sorted(str(x[:2]) for x in got) == sorted(str((i, len(t))) for i, t in rows)
    # the shared passage stays once, among the first rows, and no other byte goes
    none = sorted(x[1:] for x in got if x[0] is None)
    assert sum(n for _, n in none) == 800 and all(n in (0, 400) for _, n in none) and (150, 0) in none
    assert sorted(x[1:] for x in got if x[0] is not None) == sorted([(550, 400), (500, 0), (5, 0), (550, 400), (450, 300)])


def test_family_merges_levels(spark):
    family = substrings.Family()
    for n in range(5):
        rows = [(100 * n + i, "".join(random.Random(i if i % 3 else 1000 * n + i).choices("abcdefgh", k=300))) for i in range(12)]
        found = family.add(substrings.keyed(frame(spark, rows))).select("doc").distinct().count()
        assert found == (8 if n else 0)  # of later batches, what came before
    assert [m for m, _ in family.levels] == [level.count() for _, level in family.levels] and len(family.levels) <= 3
    assert sum(m for m, _ in family.levels) == family.levels[0][1].unionAll(family.levels[-1][1] if len(family.levels) > 1 else family.levels[0][1].limit(0)).count() or len(family.levels) == 3


# ---- 10 mixing
def test_mixing(spark):
    rows = [*prose(10, 120, 200), *ODD, (3, "again and again"), (None, "no id here")]
    df = frame(spark, rows)
    got = mixing.shares(df, block=8).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len(WORD.findall(t or ""))) for i, t in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in df.collect():
        by[r.source] = by.get(r.source, 0) + len(WORD.findall(r.text or ""))
    names = sorted(n for n in by if n is not None) + [None]
    goal = mixing.targets([by[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert float(sum(goal)) == pytest.approx(1.5 * sum(by.values()))
    assert {(r.source_size, r.target) for r in got} == {(by[n], float(t)) for n, t in zip(names, goal)}
    for n, t in zip(names, goal):
        taken = sum(r.taken for r in got if (r.source_size, r.target) == (by[n], float(t)))
        assert abs(taken - float(t)) <= 3 * 8
    assert sorted(map(str, got)) == sorted(map(str, mixing.shares(df, block=8).collect()))
    assert mixing.shares(df.where("false")).collect() == []


def test_mixed_texts_hold_the_words_taken(spark):
    df = frame(spark, prose(11, 50, 150))
    taken = {r.doc_id: r.taken for r in mixing.shares(df, block=8).collect()}
    got = {r.doc_id: r.text for r in mixing.remix(df, block=8).collect()}
    assert all(len(WORD.findall(t)) == taken[i] for i, t in got.items())
    assert all(n == 0 for i, n in taken.items() if i not in got)


def test_mixed_rows_that_share_an_id_take_their_own_words(spark):
    ids = [7, 7, 7, None, None, None, 8]
    texts = [" ".join(f"r{n}w{k}" for k in range(5 + 37 * n)) for n in range(len(ids))]
    rows = [(i, t) for i, t in zip(ids, texts)] + [(7, texts[2]), (None, texts[5]), (None, None)]
    df = frame(spark, rows)
    taken = sorted((r.doc_id or -1, r.taken) for r in mixing.shares(df, block=8).collect())
    got = [(r.doc_id or -1, r.text) for r in mixing.remix(df, block=8).collect()]
    for i, t in got:
        if t is not None:  # words of one row, none more often than the mix takes a block
            count = collections.Counter(t.split())
            assert len({w.split("w")[0] for w in count}) == 1 and max(count.values()) <= 2 and (i if i > 0 else None, texts[int(t[1 : t.index("w")])]) in rows
    assert (-1, None) in got and sum(i == -1 for i, _ in got) > 1
    assert sum(len((t or "").split()) for _, t in got) == sum(n for _, n in taken)


def test_targets():
    assert [float(t) for t in mixing.targets([10, 10, 100], [5, 2, 1])] == [20, 20, 140]
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]
    assert mixing.targets([], []) == []


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 77, np.uint64)).tolist()) == list(range(n))
