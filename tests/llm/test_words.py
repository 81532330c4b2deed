"""Words, packing, decontamination, personal data and near-duplicates against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from octolith.llm import decontam, packing, pii, simhash, textbytes

DOC = "doc_id long, text string, LANG string, Score double, spans string, fp long, component_id long, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def docs(spark, texts, ids=None):
    """A table with extra columns whose names clash with those of the operators."""
    rows = [(i, t, None, 0.5, "x", 1, 2, None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def mixed(seed=0, n=40):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "ε", "zeta,", "eta.", "x1y2", "THE", "of", "🙂", "a-b"]
    out = [" ".join(r.choice(words) for _ in range(r.choice((0, 1, 2, 3, 9, 10, 11, 60)))) for _ in range(n)]
    return [*out, None, "", "   ", "\n\t", out[3], out[3], "y" * 5000, "\x00 odd \x1c\x85 text\xa0here " * 300]


# words


@pytest.mark.parametrize("classes,pattern", [(textbytes.SPACED, "[^\x20\x09-\x0D]+"), (textbytes.ALNUM, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(classes, pattern):
    for text in mixed(1):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends = textbytes.words(raw, classes)
        want = re.findall(pattern, (text or "").translate(LOWER))
        got = [bytes(raw[a:b]).decode().translate(LOWER) for a, b in zip(starts, ends)]
        assert got == want
        keys = textbytes.keys(raw, starts, ends).tolist()
        assert [k == keys[0] for k in keys] == [w == want[0] for w in want]


# packing


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    texts = [*mixed(2), "Don't <|endoftext|> STOP. it's 12,3. É É", "word " * 9000]
    df = docs(spark, texts)
    rows = packing.pack(df, window_tokens=3000, capacity=256, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.start)
        ids = [x for r in own for x in r.ids]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert all(r.doc_tokens == len(ids) for r in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        total = sum(r.length for r in own)
        assert total <= 256 and total & (total - 1) == 0


@pytest.mark.parametrize("order", [1, -1])
def test_special_tokens_keep_their_case(spark, order):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = [f"{a}{x}{b}" for x in ("<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "<|A", "<|a") for a, b in (("", " a"), ("X", "y."), ("x", "Y."))][::order]
    want = {t: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts}
    for parts in (1, 3):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        got = {}
        for r in sorted(packing.pack(df, capacity=16, with_ids=True).collect(), key=lambda r: r.start):
            got.setdefault(texts[r.doc_id], []).extend(r.ids)
        assert got == want


def test_packing_of_rows_without_an_id_and_of_no_rows(spark):
    df = docs(spark, ["a b", "c", None, "a b"], [None, 4, None, 4])
    rows = packing.pack(df).collect()
    assert sorted({(str(r.doc_id), r.doc_tokens) for r in rows}) == [("4", 2), ("4", 3), ("None", 1), ("None", 3)] and sum(r.length for r in rows) == 9
    assert packing.pack(df.where("doc_id < 0")).count() == 0


def test_packing_balances_costs():
    r = random.Random(4)
    pieces = packing.assign([r.randint(1, 700) for _ in range(400)], 1024, 1.0, 1 / 1024)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost.setdefault(s, []).append(n)
    full = [sum(n + n * n / 1024 for n in own) for own in cost.values() if sum(own) == 1024]
    assert np.std(full) / np.mean(full) < 0.08


def test_word_memory_can_overflow():
    import pyarrow as pa

    small, large = packing.WordIds(packing.default_tokenizer(), 3, 2), packing.WordIds(packing.default_tokenizer())
    column = pa.array([t for t in mixed(3)], pa.string())
    for _ in range(2):
        assert all((a == b).all() for a, b in zip(small.batch(column), large.batch(column)))


# decontamination


def brute_hits(texts, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = []
    for t in texts:
        w = words(t)
        hit, found = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    found |= own
                    hit[i : i + k] = [True] * k
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("shard_words", [20, 2_000_000])
def test_decontamination_equals_brute_force(spark, shard_words):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)] + ["É1", "of"]
    phrase = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, phrase(n)) for k, n in enumerate((3, 10, 11, 25, 10))] + [(9, None), (10, ""), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (None, "w1")]
    texts = [phrase(r.choice((0, 5, 30, 200))) for _ in range(30)] + [f"{phrase(5)}! {t}, {phrase(5)}. {t}" for _, t in items if t] + [None, "", items[1][1], items[1][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontam.scan(docs(spark, texts), bench, shard_words=shard_words).collect()}
    want = brute_hits(texts, [x for x in items if x[0] is not None])
    assert [(got[i].n_words, got[i].n_hit, got[i].item_ids) for i in range(len(texts))] == want
    digest = {x.doc_id: x for x in decontam.digest(decontam.scan(docs(spark, texts), bench)).collect()}
    assert all(digest[i].items_sha256 == hashlib.sha256(",".join(w[2]).encode()).hexdigest() for i, w in enumerate(want))
    clean = {x.doc_id: x.text for x in decontam.decontaminate(docs(spark, texts), bench).collect()}
    assert all((clean[i] == texts[i]) if not w[1] else (i not in clean or clean[i] != texts[i]) for i, w in enumerate(want))
    assert all(i in clean or w[0] == w[1] for i, w in enumerate(want))


def test_benchmark_in_blocks_and_parts(spark, monkeypatch):
    r = random.Random(9)
    phrase = lambda n: " ".join(f"w{r.randrange(9)}" for _ in range(n))
    items = [(k, phrase(r.choice((2, 4, 12, 30)))) for k in range(40)] + [(90, phrase(12))] * 2
    items += [(91, items[3][1]), (92, items[3][1])]
    texts = [phrase(60) for _ in range(20)] + [t for _, t in items[:5]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    for block, windows in ((100, 7), (1 << 20, 3)):
        monkeypatch.setattr(decontam, "_BLOCK_BYTES", block)
        sets = decontam._blocks(bench, 10)
        assert (len(sets) > 1) == (block == 100)
        monkeypatch.setattr(decontam, "_WINDOWS", windows)
        got = {x.doc_id: x for x in decontam.scan(docs(spark, texts), bench).collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i].item_ids) for i in range(len(texts))] == want


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs(spark, ["a b"]), none).first().n_hit == 0
    assert decontam.scan(docs(spark, ["a"]).where("doc_id < 0"), none).count() == 0


# personal data


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g, d: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g, d: all(int(x) <= 255 for x in g.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda g, d: 14 <= len(d) <= 19 and luhn(d)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda g, d: 10 <= len(d) <= 15),
    ]
    spans = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(spans)]


PERSONAL = ["a@b.com_x@y.org", "é🙂 mail joe.b+1@x-y.co.uk.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999. +++1 2", "@ + . -", None, "", "a@@b.c d@e", "1" * 30_000, "a" * 30_000 + "@", "x@y.z " * 500, "+1" + "." * 5000, "12 3 4." * 300, "5500005555555559" * 3]


def test_personal_data_equals_brute_force(spark):
    r = random.Random(6)
    texts = PERSONAL + ["".join(r.choice("0123456789 .-+@ab(") for _ in range(400)) for _ in range(40)]
    got = {x.doc_id: x for x in pii.digest(pii.find(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k) for s in want) for k in ("email", "ip", "card", "phone")]


def test_checksums_and_context(spark):
    texts = ["pay to IBAN DE89 3704 0044 0532 0130 00 now", "IBAN DE89 3704 0044 0532 0130 01", "my SSN is 123-45-6789.", "part 123-45-6789."]
    got = {x.doc_id: [s.kind for s in x.spans] for x in pii.find(docs(spark, texts)).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["national_id"], 3: []}


def test_account_numbers_end_where_their_country_says(spark):
    code = "BE68539007547034"
    spaced = "BE68 5390 0754 7034"
    texts = [f"{spaced} BANK", f"{code} ING", f"{code} now", f"x{code}", f"{code}1", f"order {spaced}", f"bank order {spaced}", f"pay {code}, {spaced}.", "XX68539007547034"]
    got = {x.doc_id: [texts[x.doc_id][s.start : s.end] for s in x.spans if s.kind == "iban"] for x in pii.find(docs(spark, texts)).collect()}
    assert got == {0: [spaced], 1: [code], 2: [code], 3: [], 4: [], 5: [], 6: [spaced], 7: [code, spaced], 8: []}
    row = {x.doc_id: x for x in pii.digest(pii.find(docs(spark, ["card 4111111111111111", "order 4111111111111111"]))).collect()}
    assert (row[0].scores, row[1].scores) == ("0.95", "0.45") and row[0].n_card == row[1].n_card == 1


def test_redaction_leaves_nothing(spark):
    df = docs(spark, PERSONAL)
    out = pii.redact(df)
    assert out.columns == df.columns
    rows = {x.doc_id: x for x in out.collect()}
    assert len(rows) == len(PERSONAL)
    for i, t in enumerate(PERSONAL):
        assert (rows[i].text is None) == (t is None)
        if t is not None and not brute_spans(t):
            assert rows[i].text == t
        assert not brute_spans(rows[i].text)
    assert rows[1].text == "é🙂 mail <EMAIL>" or rows[1].text.startswith("é🙂 mail <EMAIL>")
    assert rows[1].n_chars == len(rows[1].text)


# near-duplicates


def brute_groups(texts, ids):
    fps = [simhash.fingerprint(t) for t in texts]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    return {i: min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}


def test_fingerprint_is_that_of_the_definition():
    for t in mixed(5):
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert simhash.fingerprint(t) == want


@pytest.mark.parametrize("tile", [3, 8192])
def test_links_connect_what_all_pairs_connect(spark, tile):
    r = random.Random(12)
    centres = [r.getrandbits(64) for _ in range(6)]
    values = set(centres)
    for c in centres:
        x = c
        for _ in range(25):  # chains of near values
            for _ in range(r.randint(1, 3)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), tile=tile).collect()
    mask = (1 << 64) - 1

    def classes(pairs):
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        groups = {}
        for v in values:
            groups.setdefault(find(v), []).append(v)
        return sorted(groups.values())

    every = [(a, b) for i, a in enumerate(values) for b in values[:i] if bin(a ^ b).count("1") <= 3]
    assert classes([(e.a & mask, e.b & mask) for e in edges]) == classes(every)


def test_groups_equal_brute_force(spark):
    r = random.Random(7)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(150)) for _ in range(6)]
    texts = base + [b.replace("w1", "v1", 1) for b in base] + base[:2] + [b + " end" for b in base] + [None, "", " ", "one", "one two"]
    ids = r.sample(range(1000), len(texts))
    got = {x.doc_id: x.component_id for x in simhash.groups(docs(spark, texts, ids)).collect()}
    want = brute_groups(texts, ids)
    assert got == {ids[i]: c for i, c in want.items()}
    kept = simhash.deduplicate(docs(spark, texts, ids))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))
    assert len(kept.columns) == 8


@pytest.mark.parametrize("few", [0, 16_384])
def test_components(spark, monkeypatch, few):
    from octolith.llm import components

    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(3)
    number = r.sample(range(1 << 40), 300)
    edges = [(number[i], number[i + 1]) for i in range(120)] + [(number[200], number[k]) for k in range(201, 240)] + [(number[250], number[250]), (number[0], number[1])]
    group = list(range(300))
    at = {v: i for i, v in enumerate(number)}
    for a, b in edges:
        old, new = group[at[a]], group[at[b]]
        group = [new if g == old else g for g in group]
    got = {x.v: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {v for e in edges if e[0] != e[1] for v in e}
    assert got.keys() == touched
    assert all((got[v] == got[w]) == (group[at[v]] == group[at[w]]) for v in touched for w in touched)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_dealt_out(spark):
    from octolith.llm.spark import spread_join

    left = spark.createDataFrame([(k % 3 if k > 50 else 7, k) for k in range(100)] + [(None, 1)], "key long, n long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(8)], "key long, name string")
    got = sorted(map(tuple, spread_join(left, right, "key", "n", limit=5).select("key", "n", "name").collect()))
    assert got == sorted(map(tuple, left.join(right, "key").select("key", "n", "name").collect()))


def test_nulls_repeats_and_no_rows(spark):
    df = docs(spark, ["a b c", "a b c", "a b c"], [5, 5, None])
    got = sorted((str(x.doc_id), x.component_id) for x in simhash.groups(df).collect())
    assert got == [("5", 5), ("5", 5), ("None", 5)]
    assert sorted(str(x.doc_id) for x in simhash.deduplicate(df).collect()) == ["5", "None"]
    assert simhash.groups(df.where("doc_id < 0")).count() == 0


def test_pipeline_stage_finds_all_pairs_by_jaccard(spark):
    import corpus_pipeline

    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(25)]
    texts = [*mixed(9), "a b c", "A  b c", "a b"]
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice((12, 60, 150)))]
        for edits in (0, 1, 2, 3, 5):
            own = list(base)
            for _ in range(edits):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own))
    base = [r.choice(vocabulary) for _ in range(120)]
    for _ in range(40):  # a long list: one large group, some of it only linked through others
        own = list(base)
        for _ in range(r.choice((1, 2, 3, 4))):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        texts.append(" ".join(own))
    texts += [" ".join(passage + [r.choice(vocabulary) for _ in range(r.choice((3, 6)))]) for _ in range(40)]
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= 0.8:
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = sorted(min(k for k in range(len(texts)) if group[k] == g) for g in set(group))
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, texts), "")
    assert far > 20 and sorted(row.doc_id for row in kept.collect()) == want


def test_near_duplicate_fingerprints_and_tiles(spark, monkeypatch):
    """Fingerprints are SimHash by majority, similar sets are within reach, and many small tiles find every close pair once."""
    import numpy as np
    from octolith.llm import shingles, textbytes

    r = np.random.default_rng(5)
    draw = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    for n in (1, 4, 5, 254, 255, 256, 700):
        own = draw(n)
        hashes = np.unpackbits(textbytes.mix(own[:, None] ^ shingles._SEEDS).view(np.uint8), axis=1).astype(int)
        assert (np.unpackbits(shingles.fingerprint(own).view(np.uint8)) == (2 * hashes.sum(axis=0) > n)).all()
    for shared, a, b in [(4, 1, 0), (8, 1, 1), (40, 10, 0), (40, 5, 5), (800, 100, 100)] * 40:
        both = draw(shared)
        x, y = (shingles.fingerprint(np.concatenate([both, draw(k)])) for k in (a, b))
        far = np.bitwise_count(x ^ y)
        assert far.sum() <= shingles.reach(512, 0.8) and far[:2].sum() <= shingles.reach(128, 0.8)

    monkeypatch.setattr(shingles, "_CHUNK", 7)
    monkeypatch.setattr(shingles, "_MET", 3)
    base, every = draw(60), []
    for k in range(90):
        keep = base[: r.integers(40, 61)] if k % 3 else draw(r.integers(5, 90))
        every.append(np.unique(np.concatenate([keep, draw(r.integers(0, 7))])))
    size = np.array([len(s) for s in every])
    cell = np.floor(np.log(size) / shingles._step(0.8)).astype(int)
    counts = {int(c): int((cell == c).sum()) for c in cell}
    chunk = np.arange(len(every)) % np.array([-(-counts[int(c)] // 7) for c in cell])
    words = np.array([np.concatenate([shingles.fingerprint(s), shingles.parities(s)]) for s in every])
    tiles = {}
    for c, k, tile, side in shingles.deal(counts):
        tiles.setdefault(tile, []).extend((int(i), side) for i in np.flatnonzero((cell == c) & (chunk == k)))
    found = []
    for rows in tiles.values():
        rows.sort(key=lambda x: size[x[0]])
        at, side = np.array([x[0] for x in rows], int), np.array([x[1] for x in rows], int)
        for i, j, _ in shingles.close_pairs(side, size[at], at, words[at], 0.8):
            found += [tuple(sorted(p)) for p in zip(at[i].tolist(), at[j].tolist())]
    right = {(i, j) for j in range(90) for i in range(j) if len(np.intersect1d(every[i], every[j])) >= 0.8 * len(np.union1d(every[i], every[j]))}
    assert len(right) > 100 and right <= set(found) and len(found) == len(set(found)) < 2 * len(right)


def test_near_duplicates_of_dense_tiles(spark):
    """Texts that are close to many others and linked to few: the forest of a tile leaves links to the second look."""
    from octolith.llm import shingles

    r = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for _ in range(60):
        own = list(base)
        for at in r.sample(range(200), r.choice((2, 3, 4, 5, 6))):
            own[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = {i: min(k for k in range(len(texts)) if group[k] == group[i]) for i in range(len(texts))}
    assert len(set(want.values())) > 1
    assert {x.doc_id: x.component_id for x in shingles.groups(docs(spark, texts)).collect()} == want
