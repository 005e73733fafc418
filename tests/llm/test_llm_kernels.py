import random
import zlib

import numpy as np
import pytest

from wavemill.llm import decontaminate, licences, near_dedup, pieces, pretokens, quality, rolling, suffix_dedup, token_store, toxicity

TOKENIZERS = pytest.importorskip("public_tokenizers")


def texts(seed=0, n=200):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\t'abs1é,. ") for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "a", "½ x²y ٣٤ __ 'll", "<|endoftext|> x", "éa 中文 字", "🙂 ok", "a\xa0b \xa0c", "x\n y"]


def test_pretoken_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("byte_bpe_50k.json")
    library, encode = Tokenizer.from_file(path), pretokens.encoder(path)
    ts = texts()
    assert [x.tolist() for x in encode(ts)] == [library.encode(t, add_special_tokens=False).ids for t in ts]
    assert [x.tolist() for x in encode(ts[:50])] == [library.encode(t, add_special_tokens=False).ids for t in ts[:50]]


def test_word_ids_forget(monkeypatch):
    from wavemill.llm import word_ids

    monkeypatch.setattr(word_ids, "MOST", 5)
    monkeypatch.setattr(word_ids, "mix", lambda x: x % np.uint64(3))  # words share hashes: their bytes tell them apart
    w = word_ids.WordIds(lambda ws, first: word_ids.laid_out([[zlib.crc32(x.encode()) % 97, f] for x, f in zip(ws, first, strict=True)]), True)
    for k in range(4):
        ts = [f"a b{k} c d e f g{k}", "a", "", "q b a"]
        want = [[v for i, x in enumerate(t.split(" ")) for v in (zlib.crc32(x.encode()) % 97, i == 0)] if t else [] for t in ts]
        assert [x.tolist() for x in w.encode(ts)] == want


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 70_000).astype(np.uint32)
    counts = np.bincount(ids)
    lengths = token_store.code_lengths(counts)
    assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1 + 1e-12 and ((lengths > 0) == (counts > 0)).all()
    codes = token_store.canonical(lengths)
    bits, marks = token_store.pack(ids, codes, lengths)
    assert (token_store.unpack(bits, marks, n, token_store.lookup(lengths, codes)) == ids).all()


def test_lengths_are_optimal_and_limited():
    import heapq

    counts = np.array([2**k for k in range(24)])
    lengths = token_store.code_lengths(counts)
    assert lengths.max() == token_store.LONGEST
    counts = np.array([5, 9, 12, 13, 16, 45, 0])
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * token_store.code_lengths(counts)).sum()) == cost
    assert token_store.code_lengths(np.zeros(4, dtype=int)).sum() == 0 and token_store.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def whole_viterbi(w, text):
    m = pieces.MARK + text.replace(" ", pieces.MARK)
    best = [0.0] + [float("-inf")] * len(m)
    for i in range(len(m)):
        for j in range(i + 1, min(len(m), i + 48) + 1):
            s = w.score.get(m[i:j], w.out if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_pieces_score_and_round_trip():
    w = pieces.Pieces(pieces.default_model())
    by_id = {i: w.score[p] for p, i in w.id.items()}
    plain = [t for t in ["the cat sat on the mat", "Thend hend then", "a  b", " x ", "x y z" * 30] + texts(3, 40) if t and all(c in w.score for c in pieces.MARK + t.replace(" ", pieces.MARK))]
    assert len(plain) > 5
    for t in plain:
        assert sum(by_id[i] for i in w.encode([t])[0].tolist()) == pytest.approx(whole_viterbi(w, t))
    ts = texts(4) + ["🙂 中文 tab\tq", "x" * 3000]
    assert [w.decode(x) for x in w.encode(ts)] == ts
    assert w.decode(w.encode(["x▁y"])[0]) == "x y"


def test_shingles_and_signatures():
    assert len(near_dedup.shingles("")) == 0 and len(near_dedup.shingles(" \t\n ")) == 0 and len(near_dedup.shingles("a b")) == 1
    assert len(near_dedup.shingles("a b c d e f")) == 2 and (near_dedup.shingles("A B c") == near_dedup.shingles("a\tb\n\nc")).all()
    assert len(near_dedup.shingles("\xa0 b")) == 1 and not (near_dedup.shingles("a\xa0b") == near_dedup.shingles("a b")).any()
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(400)]
    a, b = near_dedup.shingles(" ".join(base)), near_dedup.shingles(" ".join(base[:380] + base[:0]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = (np.frombuffer(near_dedup.signature(s), dtype=np.uint8) for s in (a, b))
    assert abs((x == y).mean() - true) < 0.06
    least = near_dedup.least_matches(0.85, 1e-6)
    assert all(m < n * 0.85 for m, n in zip(least, range(near_dedup.BATCH, near_dedup.HASHES + 1, near_dedup.BATCH), strict=True)) and least[-1] > 0.7 * near_dedup.HASHES


def test_phrases_cover_all_starts():
    rng = np.random.default_rng(0)
    for n in (0, 99, 100, 101, 500, rolling.PART + 5, 3 * rolling.PART):
        data = rng.integers(0, 4, n).astype(np.uint8)
        _, _, first, count = suffix_dedup.phrases(data)
        starts = [p for a, k in zip(first.tolist(), count.tolist(), strict=True) for p in range(a, a + k)]
        assert starts == list(range(max(0, n - 99)))


def test_decontamination_words():
    assert decontaminate.words("Ab-c1 É, x y") == [b"ab", b"c1", "É".encode(), "x y".encode()]
    m = decontaminate.automaton([(1, "one two three"), (2, " ".join(map(str, range(12)))), (3, "...")])
    n, hits, items = decontaminate.scan("zero ONE, two three! " + " ".join(map(str, range(1, 12))), m)
    assert (n, hits, items) == (15, [(1, 15)], {1, 2})
    text = "é ONE, two  three."
    (a, b), = decontaminate.original_spans(text, decontaminate.scan(text, m)[1])
    assert text.encode()[a:b] == b"ONE, two  three"
    assert decontaminate.scan("ones two three", m)[1] == [] and decontaminate.scan(None, m) == (0, [], set())


def test_folding_and_lexicon():
    assert toxicity.fold("M0r0n!").split() == toxicity.fold("moron").split() and toxicity.fold("іdі0t") == toxicity.fold("IDIOT")
    assert toxicity.fold("p@thétic") == toxicity.fold("pathetic") and toxicity.fold("") == " "
    lex = toxicity.Lexicon({toxicity.fold("moron"): 2.0, " idi": 1.0}, ("no moron",))
    assert lex.measure("a MORON, idiots") == (3.0, 3, 2) and lex.measure("no moron here")[0] == 0.0 and lex.measure("") == (0.0, 0, 0)
    assert lex.measure("oxymoron")[0] == 0.0


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 300)
    at = [np.array([0, 1 + g], dtype=np.int32) for g in y]
    m = quality.fit_ordinal(at, [np.ones(2, dtype=np.float32)] * 300, y, width=4, steps=300)
    assert (np.diff(m["cuts"]) > 0).all()
    f = m["w"][1:] + m["w"][0]
    assert f[0] < m["cuts"][0] < f[1] < m["cuts"][1] < f[2]


def test_ordinal_regression_takes_a_block_of_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 2000)
    at = [np.sort(rng.choice(3000, 500, replace=False)).astype(np.uint16) if k else np.zeros(0, dtype=np.uint16) for k in range(2000)]
    v = [rng.random(len(a), dtype=np.float32) for a in at]
    whole = quality.fit_ordinal(at, v, y, width=3000, steps=3)
    monkeypatch.setattr(quality, "FIT_SLOTS", 10_000, raising=False)
    tracemalloc.start()
    m = quality.fit_ordinal(at, v, y, width=3000, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4e6  # the million slots alone are 8 MB as doubles
    assert m["w"] == pytest.approx(whole["w"], abs=1e-9) and m["cuts"] == pytest.approx(whole["cuts"], abs=1e-9)


def test_quality_slots():
    for t in ("", "x", "ab", "one two two\n\n"):
        assert np.isfinite(quality.score_text(t, np.ones(quality.WIDTH)))


def test_licences():
    m = licences.train([licences.features(licences.word_hashes(t)[0]) for t in ("plain words of a text", "another line of words here", "the cat sat on the mat")] * 5)
    s = licences.Scanner(m)
    assert m["accuracy"] > 0.9
    for f, notices in licences.NOTICES.items():
        for n in notices:
            if len(licences.word_hashes(n)[0]) >= 3:
                assert [x["family"] for x in s.text("intro line\n" + n)[1]] == [f], n
    for n in licences.NEAR_MISSES:
        assert s.text(n)[1] == []
    long = "w " * 300 + licences.NOTICES["MIT"][2] + " w" * 300
    found = s.text("é\n" + long)[1]
    assert {x["family"] for x in found} <= {"MIT"} and s.text("") == (0, [])


def test_licences_over_lines_and_together():
    m = licences.train([licences.features(licences.word_hashes(t)[0]) for t in ("plain words of a text", "another line of words here", "the cat sat on the mat")] * 5)
    s = licences.Scanner(m)
    names = lambda t: {x["family"] for x in s.text(t)[1]}
    for f, notices in licences.NOTICES.items():
        for n in notices:
            words = n.split()
            for k in range(1, len(words) if len(licences.word_hashes(n)[0]) >= 3 else 0):
                assert names("# intro\n#\n# " + " ".join(words[:k]) + "\n# " + " ".join(words[k:]) + "\n") == {f}, (n, k)
    assert names("Licensed under the MIT license or Apache License, Version 2.0") == {"MIT", "Apache-2.0"}
    assert names("released under the MIT license or the BSD license") == {"MIT", "BSD"}
    assert names("This work is licensed under the GNU Affero General Public License, version 3") == {"AGPL-3.0"}
    assert s.text("a b\nc\n\n//\nd\n * \n\n")[0] == 2 and s.text("\n\n\nx")[0] == 1


def thue_morse(n):
    """Two words of n letters that agree under any polynomial modulo 2^64 with an odd base, from n = 1,024 on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_tell_words_apart():
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("byte_bpe_50k.json")
    library, encode, walker = Tokenizer.from_file(path), pretokens.encoder(path), pieces.Pieces(pieces.default_model())
    for n in (1024, 2048, 4096, 1 << 15):
        a, b = thue_morse(n)
        x, y = near_dedup.word_hashes(f"{a} {b}").tolist()
        assert x != y and not len(np.intersect1d(near_dedup.shingles(a), near_dedup.shingles(b)))
        text = f"x {a} {b} {a}"
        assert encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert walker.decode(walker.encode([text])[0]) == text


def test_range_hashes_do_not_depend_on_the_place():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 700_000).astype(np.uint8)
    data[500_000:540_000] = data[1_000:41_000]
    start = np.array([0, 1_000, 3_000, 20_000, 300_000, 500_000, 502_000, 519_000])
    end = np.array([5, 41_000, 3_007, 20_100, 300_007, 540_000, 502_007, 519_100])
    for lane in (0, 1):
        h = rolling.range_hashes(data, start, end, lane).tolist()
        assert h[1] == h[5] and h[2] == h[6] and h[3] == h[7] and len(set(h)) == 5
    a, b = rng.integers(0, rolling.PRIME, (2, 1000)).astype(np.uint64)
    a[:3], b[:3] = rolling.PRIME - 1, [rolling.PRIME - 1, 0, 1]
    assert rolling.times(a, b).tolist() == [x * y % rolling.PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_ranks_are_a_suffix_array():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    for length in (5, 8, 20, 100):
        r = suffix_dedup.ranks(data, length)
        s = [data[k : k + length].tobytes() for k in range(len(data) - length + 1)]
        order = sorted(set(s))
        assert r.tolist() == [order.index(x) for x in s]
    assert len(suffix_dedup.ranks(data[:9], 10)) == 0


def test_stage_workers_give_memory_back(monkeypatch):
    import pyarrow as pa

    from wavemill.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    ids, ts = pa.array([1, 2, 3, 4], pa.int64()), pa.array(["a b c d e f", "a b c d e f g", "x y", None])
    docs = [pa.RecordBatch.from_arrays([ids, ts], ["doc_id", "text"])] * 3
    rated = [pa.RecordBatch.from_arrays([ids, ts, pa.array([0, 1, 0, 1], pa.int64())], ["doc_id", "text", "y"])]
    sparse = list(quality.sparse_rows(iter(rated)))
    sketches = list(near_dedup.sketched(iter(docs)))[0]
    group = [pa.array([7] * 3, pa.int64()), pa.array([0] * 3, pa.int32()), pa.array([0] * 3, pa.int32()), pa.array([0] * 3, pa.int32()), ids[:3], sketches.column(3)[:3]]
    names = [*near_dedup.GROUP, "side", "id", "sig"]
    sets = list(near_dedup.whole_sets(iter(docs)))[0].column(1)[:3]
    least = near_dedup.least_matches(0.85, 1e-6)
    runs = [
        (quality.sparse_rows, rated), (quality.fitted, sparse), (quality.scored({"w": np.zeros(quality.WIDTH)}), docs), (near_dedup.sketched, docs), (near_dedup.whole_sets, docs),
        (near_dedup.link_buckets(least), [pa.RecordBatch.from_arrays(group, names)]), (near_dedup.link_canopies(least, 85), [pa.RecordBatch.from_arrays([*group, sets], [*names, "shingles"])]),
        (decontaminate._without_hits([(1, "p q r")], 10), docs), (decontaminate.scanner([(1, "p q r")], 10, False), docs), (pieces.encoded(pieces.default_model(), True), docs),
    ]
    for run, batches in runs:
        given.clear()
        assert sum(b.num_rows for b in run(iter(batches))) >= 0 and len(given) == 1
    given.clear()
    assert sum(b.num_rows for b in common.lean(iter, each=1)(docs)) == 12 and len(given) == 4  # after each batch, and at the end


def test_pieces_keep_a_part_of_the_words(monkeypatch):
    from wavemill.llm import word_ids

    rng = random.Random(5)
    ts = [" ".join("".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(40)) for _ in range(40)]
    want = [x.tolist() for x in pieces.Pieces(pieces.default_model()).encode(ts)]
    monkeypatch.setattr(word_ids, "MOST", 400)
    w = pieces.Pieces(pieces.default_model())
    for k in range(0, 40, 2):
        assert [x.tolist() for x in w.encode(ts[k : k + 2])] == want[k : k + 2]
        assert len(w.kept.keys) <= 400 // pieces.KEPT_PART + 80  # of the last batch
