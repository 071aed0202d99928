import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P

from tidegraph.llm import jaccard_join, media, mixing, sentencepiece_codec, sharding, substring_dedup, token_binary, token_counts, toxicity
from tidegraph.llm.words import Words

ODD = ["", None, "a", "  \n\t ", "don't  stop.\n\n  Go!\x1c x", "İstanbul ΣΑΣ — ½ ²", "<|endoftext|> x <|startoftext|>y </s>", "▁a ▁ b▁", "tab\tand nbsp  em", "日本語 テキスト 🙂🙂", "# ## 12 34a", "x " * 3000]
SCHEMA = "doc_id long, text string, source string, part int, sig long"


def table(spark, texts, sources=("b", None, "a")):
    rows = [(i, t, sources[i % len(sources)], 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, "null id", "a", 1, 2)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, ODD), path).collect()}
    for i, t in enumerate(ODD):
        assert got[i].n_tokens == len(own.encode(t or "", add_special_tokens=False).ids), t
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (got[i].n_tokens > 1024)
    assert token_counts.count_tokens(empty(spark), path).count() == 0
    for t in ODD:
        assert "".join(token_counts.safe_chunks(t or "")) == (t or "")


def test_token_segments_round_trip(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ODD + ["the cat sat on the mat " * 50] * 3
    stored = token_binary.write_shards(table(spark, texts), path, partition_bytes=4000)
    rows = sorted(token_binary.token_index(stored).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        t = "null id" if r.doc_id is None else texts[r.doc_id]
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)
    assert len(rows) == len(texts) + 2
    seg = token_binary.Segment(stored.orderBy("part", "segment").first()["content"])
    for i, d in enumerate(seg.doc_ids):
        t = "null id" if d is None else texts[d]
        assert seg.document(i).tolist() == own.encode(t or "", add_special_tokens=False).ids + [2]
    whole = seg.tokens()
    for a, b in ((0, 1), (3, 17), (len(whole) - 5, len(whole) + 9), (40, 400), (7, 7)):
        assert seg.stretch(a, b).tolist() == whole[a:b].tolist()
    with pytest.raises(ValueError):
        token_binary.Segment(b"x" * 60)
    with pytest.raises(ValueError):
        token_binary.WordEncoder(P.path("byte_bpe_50k.json"))
    assert token_binary.token_index(token_binary.write_shards(empty(spark), path)).count() == 0


def test_words_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, words = Tokenizer.from_file(path), token_binary.WordEncoder(path)
    r = random.Random(5)
    bits = ["Hello", " ", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É", "e\u0301", "İ", "ΣΑΣ", "ς", "don't", "'s", "1", "½", "\u00a0", "\x01", "\x00", "\x1c", "\x85", "日本", "🙂", "a.b", ",", "!!", "word", "\t", "\n", "ﬁ", "ǅ", "\u0338", "="]
    texts = ["".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(14))) for _ in range(3000)] + ["Hello World <| x", "日本語" * 4000, "Long " * 20_000]
    got = words.encode(texts)
    cuts = np.flatnonzero(got == token_binary.END)
    for t, x in zip(texts, np.split(got, cuts + 1)):
        assert x[:-1].tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_wide_symbols_round_trip():
    r = np.random.default_rng(2)
    seq = np.concatenate([r.integers(0, 40, 4000) + 70_000, [token_binary.END], np.tile([99_999, 70_001], 300), [token_binary.END]]).astype(np.uint32)
    stored = token_binary.write_segment([5, None], seq, 100_000, 2)
    back = token_binary.Segment(stored)
    assert back.doc_ids == [5, None] and back.token_ends.tolist() == [4001, 4602]
    assert back.tokens().tolist() == np.where(seq == token_binary.END, 2, seq).tolist()
    assert len(back.symbols) < len(seq) - 500


def test_grammar_expands_to_what_was_compressed():
    r = np.random.default_rng(1)
    seq = np.concatenate([r.integers(0, 5, 5000), np.full(400, 3), [65535], np.tile([1, 2, 3, 4], 500)]).astype(np.uint16)
    symbols, left, right, sizes = token_binary.compress(seq, 100)
    assert len(symbols) < len(seq) / 2 and (symbols == 65535).sum() == 1
    g = token_binary.Grammar(100, left, right, sizes)
    parts = np.split(symbols, np.flatnonzero(symbols == 65535))
    assert np.concatenate((g.expand(parts[0]), [65535], g.expand(parts[1][1:]))).tolist() == seq.tolist()


def test_pieces_equal_the_library_and_spans_cover_the_text(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in sentencepiece_codec.encode_documents(table(spark, ODD), path).collect()}
    brief = {r.doc_id: r for r in sentencepiece_codec.encode_documents(table(spark, ODD), path, sentencepiece_codec.digests, sentencepiece_codec.DIGESTS).collect()}
    for i, t in enumerate(ODD):
        t, r = t or "", got[i]
        ids = sp.encode(t)
        assert r.ids == ids and r.decoded == sp.decode(ids), t
        assert all(a <= b for a, b in zip(r.begins, r.ends)) and r.begins[1:] == r.ends[:-1]
        if ids:
            assert (r.begins[0], r.ends[-1]) == (0, len(t.encode()))
        assert brief[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert brief[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(empty(spark), path).count() == 0


def double_array(entries):
    """A small double-array trie over bytes, built from a dict of key bytes to values."""
    units = [0] * 4096
    used = {0}

    def place(pos, keys):
        labels = sorted({k[0] if k else 0 for k in keys})
        base = next(b for b in range(256, 2048) if all((b ^ c) not in used for c in labels))
        units[pos] |= (pos ^ base) << 10
        for c in labels:
            used.add(base ^ c)
        for c in labels:
            if c == 0:
                units[pos] |= 1 << 8
                units[base] = keys[b""] | (1 << 31)
            else:
                units[base ^ c] |= c
                place(base ^ c, {k[1:]: v for k, v in keys.items() if k and k[0] == c})

    place(0, entries)
    return np.array(units, "<u4").tobytes()


def test_character_map_takes_the_longest_prefix():
    pool, at = b"", {}
    for k, v in {"A": "a", "AB": "xy", "ﬁ": "fi", "é": "e"}.items():
        at[k.encode()] = len(pool)
        pool += v.encode() + b"\0"
    trie = double_array(at)
    m = sentencepiece_codec.CharacterMap(len(trie).to_bytes(4, "little") + trie + pool)
    text, places = sentencepiece_codec.normalize_with_alignment("ABA ﬁ é!", m, dummy_prefix=False)
    assert text == "xya▁fi▁e!"
    assert places.tolist() == [0, 0, 2, 3, 3, 3, 4, 4, 7, 7, 7, 8, 10, 11]
    squeezed, places = sentencepiece_codec.normalize_with_alignment("  a  b ", sentencepiece_codec.CharacterMap(b""), squeeze=True)
    assert squeezed == "▁a▁b" and places[0] == 2


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.document_media(table(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].n_bytes == len(raw)
        assert got[i].tail_crc32 == zlib.crc32(payload[-16:])
        for f in (0, 1, 2):
            assert media.decode_png(media.encode_png(payload, f)).tobytes() == payload
    stored = media.encode_png(b" " * 192)
    for bad in (stored[:-5], b"x" + stored[1:], stored[:60] + bytes([stored[60] ^ 1]) + stored[61:]):
        with pytest.raises((media.MediaError, zlib.error)):
            media.decode_png(bad)
    assert media.document_media(empty(spark)).count() == 0


def test_all_five_row_filters():
    r = np.random.default_rng(2)
    data = r.integers(0, 256, (5, 12)).astype(np.uint8)
    lines = np.zeros_like(data)
    for y in range(5):
        for x in range(12):
            left = int(data[y, x - 3]) if x >= 3 else 0
            up = int(data[y - 1, x]) if y else 0
            corner = int(data[y - 1, x - 3]) if y and x >= 3 else 0
            p = left + up - corner
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            lines[y, x] = (int(data[y, x]) - (0, left, up, (left + up) // 2, near)[y]) & 255
    assert (media.unfilter(np.arange(5), lines, 3) == data).all()


def brute_jaccard(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def near_copies(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 6, 9, 12, 15, 26, 60, 120]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 3])):
            k = r.randrange(len(w))
            w[k:k + r.choice([0, 1])] = [r.choice(vocabulary)] * r.choice([0, 1])
            w = w or ["x"]
        rows.append((i, " ".join(w)))
    return rows


def test_jaccard_join_equals_brute_force(spark):
    rows = near_copies(3, 400) + [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, "\x0b")]
    df = spark.createDataFrame(rows + rows[:3] + [(None, "a b c d e f g")], "doc_id long, text string")
    got = jaccard_join.near_duplicates(df).collect()
    assert len(got) == len(rows) + 4
    want = brute_jaccard(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert {r.doc_id for r in jaccard_join.one_of_each(df).collect() if r.doc_id is not None} == {d for d, (_, c) in want.items() if c == d}


def test_jaccard_join_of_a_crowd_near_the_threshold(spark):
    r = random.Random(11)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for i in range(700):
        own = list(base if i % 3 else [*base[:35], *[f"x{j}" for j in range(35)]])
        for _ in range(r.randrange(0, 4)):
            own[r.randrange(len(own))] = f"r{r.randrange(60)}"
        texts.append(" ".join(own[:r.randrange(60, 71)]))
    rows = [(i, x) for i, x in enumerate(texts)]
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(rows)
    assert len({c for _, c in got.values()}) > 3


def test_common_counts_equal_set_intersections():
    rng = np.random.default_rng(3)
    xs, ys = ([np.unique(rng.integers(0, 300, rng.integers(0, 120)).astype(np.uint64)) for _ in range(n)] for n in (90, 40))
    got = jaccard_join.common_counts(xs, ys)
    assert [[len(set(a.tolist()) & set(b.tolist())) for b in ys] for a in xs] == got.astype(int).tolist()


def test_jaccard_join_without_rows(spark):
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0


def test_compact_windows_equal_brute_force():
    r = np.random.default_rng(4)
    s = r.integers(0, 1 << 62, 90).astype(np.uint64)
    offsets = np.array([0, 40, 90])
    for h in (0, 3):
        c, first, last = substring_dedup.compact_windows(s, offsets, 10, h)
        own = {(x, a, b) for x, a, b in zip(c.tolist(), first.tolist(), last.tolist())}
        g = substring_dedup.mix(s + substring_dedup._STEP * np.array([h + 1], np.uint64)) >> np.uint64(24)
        want = set()
        for a, b in ((0, 40), (40, 90)):
            for x in range(a, b):
                lo, hi = x, x
                while lo > a and g[lo - 1] > g[x]:
                    lo -= 1
                while hi + 1 < b and g[hi + 1] > g[x]:
                    hi += 1
                if hi - lo + 1 >= 10:
                    want.add((x, lo, hi))
        assert own == want


def test_repeated_passages_are_found_and_cut(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    near = list(passage)
    near[30] = "changed"
    text = lambda mid: " ".join([word() for _ in range(80)] + mid + [word() for _ in range(70)])
    rows = [(1, text(passage)), (2, text([])), (3, text(passage)), (4, text(near)), (5, " ".join(passage)), (6, None), (7, "short"), (8, text([]))]
    rows.append((9, rows[1][1]))
    df = spark.createDataFrame([(*x, None, "s", 3) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {(x.doc_id, x.source_id): (x.begin_word, x.end_word) for x in substring_dedup.repeated_passages(df).collect()}
    assert {d for d, _ in found} == {3, 4, 5, 9} and found[(9, 2)] == (0, 150)
    a, b = found[(3, 1)]
    assert 75 <= a <= 80 and 140 <= b <= 145
    kept = {x.doc_id: x for x in substring_dedup.remove_repeats(df).collect()}
    assert set(kept) == {1, 2, 3, 4, 6, 7, 8} and passage[20] not in kept[3].text and passage[20] in kept[1].text
    assert kept[2].text == rows[1][1] and kept[3].n_chars == len(kept[3].text)
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0


def test_repeated_passages_do_not_depend_on_the_order_of_the_rows(spark):
    r = random.Random(21)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    p, q = words(80), words(80)
    five = " ".join(words(60) + p + words(60) + q + words(60))
    rows = [(10, five), (5, five), (3, " ".join(words(70) + p + words(40))), (7, " ".join(words(40) + q + words(70)))]
    want = {(10, 5), (5, 3), (7, 5)}
    for order in (rows, rows[::-1], sorted(rows)):
        df = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert {(x.doc_id, x.source_id) for x in substring_dedup.repeated_passages(df).collect()} == want


def test_links_of_contexts_equal_brute_force():
    r = random.Random(5)
    t, base = 46, [np.array([r.getrandbits(32) for _ in range(91)], np.uint32) for _ in range(3)]
    tokens = []
    for _ in range(120):
        x = r.choice(base).copy()
        for _ in range(r.randint(0, 4)):
            k = r.randrange(91)
            x[k:k + r.randint(1, 9)] = r.getrandbits(32)
        tokens.append(x[r.randint(0, 20):r.randint(70, 91)])
    ids = np.array(r.sample(range(1000), 120))
    linked = {(x, y) for x in range(120) for y in range(120) if ids[x] > ids[y] and substring_dedup.matching_stretches(tokens[x], tokens[y], t)}
    far = set(range(120)) - {x for x, _ in linked}
    sides = np.array([r.randrange(2) for _ in range(120)])

    def groups(pairs):
        home = list(range(120))
        for _ in range(120):
            for x, y in pairs:
                home[x] = home[y] = min(home[x], home[y])
        return home

    for side, true in ((np.zeros(120, int), linked), (sides, {(x, y) for x, y in linked if sides[x] != sides[y]})):
        found = {(x, y) for x, y, _, _ in substring_dedup.context_links(ids, ids, np.zeros(120, bool), side, tokens, t)}
        assert found <= true and {x for x, _ in found} == {x for x, _ in true} and groups(found) == groups(true)
    assert far and len(linked) > 300
    # settled rows are only compared with other components
    assert not substring_dedup.context_links(ids, np.zeros(120, int), np.ones(120, bool), np.zeros(120, int), tokens, t)


def test_windows_without_links_keep_a_list_open():
    lists, docs = np.array([7, 7, 7, 7, 8, 8, 7, 8]), np.array([1, 2, 3, 3, 1, 2, 3, 2])
    others, links, centres = np.array([1, 2, 3, 3, 1, 2, 1, 1]), np.array([0, 0, 0, 0, 0, 0, 1, 1], bool), np.array([5, 5, 5, 90, 5, 5, 5, 5])
    at, comp, settled = substring_dedup.open_windows(lists, docs, others, links, centres)
    assert sorted(zip(at.tolist(), comp.tolist(), settled.tolist())) == [(0, 1, False), (1, 2, False), (2, 1, True), (3, 1, False)]


def test_partners_deep_in_a_long_list_are_found(spark):
    r = random.Random(77)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line, rows = [word() for _ in range(30)], []
    for i in range(60):
        # a line that all share, in passages of which only some pairs are the same
        own = [word() for _ in range(20)] + line + [word() for _ in range(20)] if i < 40 else rows[i - 40][1]
        rows.append((i, own, " ".join([word() for _ in range(60)] + own + [word() for _ in range(60)])))
    df = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, text string")
    found = {(x.doc_id, x.source_id) for x in substring_dedup.repeated_passages(df).collect()}
    assert found == {(i, i - 40) for i in range(40, 60)}


def test_stretches_with_repeated_lines_equal_brute_force():
    r = random.Random(31)
    t, need = 46, 40

    def shingles(words):
        return np.array([zlib.crc32(" ".join(words[i:i + 5]).encode()) for i in range(len(words) - 4)], np.uint32)

    words = lambda n: [str(r.getrandbits(40)) for _ in range(n)]
    found = lambda x, y: substring_dedup.matching_stretches(shingles(x), shingles(y), t)
    line, p = words(20), words(60)
    # a passage made of a line again and again; a passage with a line that stands earlier in y too
    assert found(words(30) + line * 6 + words(30), words(50) + line * 6 + words(10)) == [(30, 30 + 116 - 1)]
    p[20:40] = line
    assert found(words(30) + p + words(30), words(10) + line + words(200) + p + words(10)) == [(30, 85)]
    assert found(words(30) + line * 6, words(30) + line + words(30) + line) == [] and found(line * 3, line) == []
    assert found(["w"] * 20_000, ["w"] * 15_000) == [(0, 19_995)] and found(words(200), []) == []
    long = words(300)
    assert found(long[:150] + words(1) + long[150:], long[:60] + long[63:]) in ([(0, 296)], [(0, 57), (61, 296)])
    # exact repeats by brute force, over few lines
    lines = [words(r.randint(6, 30)) for _ in range(4)]
    for _ in range(30):
        x, y = (shingles([w for _ in range(12) for w in r.choice(lines)]) for _ in range(2))
        have = {y[j:j + t].tobytes() for j in range(len(y) - t + 1)}
        places = {k for a, b in substring_dedup.matching_stretches(x, y, t) for k in range(a, b + 1)}
        for i in range(len(x) - t + 1):
            assert x[i:i + t].tobytes() not in have or places >= set(range(i, i + t))


def test_mixing_meets_its_targets(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randint(1, 40)), r.choice(["a"] * 6 + ["b", "c", None]), 1, 2) for i in range(900)] + [(2000, None, "a", 1, 2), (2001, "x", "zero", 1, 2), (2002, "", "none", 1, 2)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, *_ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, open_, want = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not full:
            want |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
        # the weights of those that are full count no more
    taken = defaultdict(int)
    for x in got:
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source]) and x.taken <= 2 * x.size
        taken[x.source] += x.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= 40
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_shards_reach_the_least_capacity(spark):
    r = random.Random(8)
    texts = ["x" * r.randint(0, 300) + str(r.randint(0, 250)) for _ in range(600)] + ["hot" * 9] * 200
    got = sharding.shard_documents(table(spark, texts)).collect()
    sizes, shard_of = Counter(), {}
    for x in got:
        t = "null id" if x.doc_id is None else texts[x.doc_id]
        assert x.size == len(t) + 1 and x.text_crc32 == zlib.crc32(t.encode()) and x.law == "bytes"
        assert shard_of.setdefault(t, x.shard) == x.shard
        sizes[x.shard] += x.size
    for k in range(8):
        slots = sorted(x.slot for x in got if x.shard == k)
        assert slots == list(range(len(slots)))
    groups = Counter()
    for x in got:
        groups["null id" if x.doc_id is None else texts[x.doc_id]] += x.size
    order = spark.createDataFrame([(t, n) for t, n in groups.items()], "t string, n long").selectExpr("n", "shiftrightunsigned(xxhash64(t), 4) h").orderBy("h").collect()

    def fits(c):
        used, now = 1, 0
        for x in order:
            if x.n > c:
                return False
            if now + x.n > c:
                used, now = used + 1, 0
            now += x.n
        return used <= 8

    best = next(c for c in range(sum(groups.values()) // 8, sum(groups.values()) + 1) if fits(c))
    assert max(sizes.values()) <= best
    assert sharding.shard_documents(empty(spark)).count() == 0
    nulls = sharding.shard_documents(spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")).collect()
    assert all(x.size == 1 and x.text_crc32 == 0 for x in nulls)


def test_network_gradients_and_scores(spark):
    net = toxicity.Network(3)
    r = np.random.default_rng(0)
    x = r.normal(size=(6, 16)).astype(np.float32)
    at = r.integers(1, 6, (3, toxicity.WINDOW))
    at[0, 5:] = 0
    mask = (at > 0).astype(np.float32)
    gates = net.project(x).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    z, cache = net.run(gates, at, mask, keep=True)
    g, dgates = net.back(at, mask, cache, np.ones(3), 6)
    for k in ("u", "wa", "va", "wo"):
        i = tuple(n // 2 for n in net.p[k].shape)
        net.p[k][i] += 1e-2
        up = net.run(gates, at, mask).sum()
        net.p[k][i] -= 2e-2
        down = net.run(gates, at, mask).sum()
        net.p[k][i] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][i]) < 2e-2 * max(1, abs(g[k][i]))
    gates[2, 4] += 1e-2
    up = net.run(gates, at, mask).sum()
    gates[2, 4] -= 2e-2
    assert abs((up - net.run(gates, at, mask).sum()) / 2e-2 - dgates[2, 4]) < 2e-2
    assert toxicity.windows_of(40) == [(0, 32), (8, 40)] and toxicity.windows_of(0) == [(0, 0)]


def test_toxicity_learns_and_scores_odd_texts(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(5))
    texts = [" ".join([word() for _ in range(60)] + (["idiot"] if i % 3 == 0 else []) + [word() for _ in range(r.randint(5, 50))]) for i in range(240)]
    df = table(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    net = toxicity.fit_on(df, labels)
    got = [x for x in toxicity.score_documents(df, net).collect()]
    assert len(got) == len(texts) + len(ODD) + 2 and all(0 <= x.score <= 1 for x in got)
    out = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 240]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert sum((x.predicted == 1) == (x.doc_id % 3 == 0) for x in out) >= 0.85 * len(out)
    kept = toxicity.keep_clean(df, net).count()
    assert kept == sum(x.predicted == 0 for x in got)
    assert toxicity.score_documents(empty(spark), net).count() == 0


def test_words_are_split_at_ascii_blanks_only():
    w = Words(["A b\x0bc d", "", None, "a B c D"])
    assert np.diff(w.offsets).tolist() == [3, 0, 0, 3]
    assert w.hashes[0] == w.hashes[3] and w.hashes[1] == w.hashes[4] and w.hashes[2] == w.hashes[5]


def test_taken_rows_equal_the_mix_for_null_and_repeated_ids(spark):
    r = random.Random(4)
    rows = [(None if i % 3 == 0 else i // 2, " ".join("w" for _ in range(r.randrange(1, 30))) + f" {i}", r.choice(["a", "b", "c", None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    per_source = lambda x, n: {s: sum(n(y) for y in x if y["source"] == s) for s in ("a", "b", "c", None)}
    told = per_source(mixing.mix_sources(df).collect(), lambda y: y["taken"])
    took = mixing.take_mix(df)
    assert took.columns == df.columns
    assert per_source(took.collect(), lambda y: len(y["text"].split())) == told
    assert mixing.take_mix(df.limit(0)).count() == 0


def test_scores_are_the_largest_over_all_windows():
    texts = [f"good day to you {i}" for i in range(40)] + [f"you vile{i} scum" for i in range(40)]
    net = toxicity.fit([*texts, *texts], [0] * 40 + [1] * 40 + [0] * 40 + [1] * 40)
    scorer = toxicity.Scorer(net)
    r = random.Random(2)
    for n in (0, 1, 31, 32, 33, 200, 3000):
        words = [r.choice(["good", "day", "vile", "scum", "antidisestablishmentarianism", "日本語" * 9]) for _ in range(n)]
        x = net.project(net.embed(words)[3]) if words else np.zeros((0, 6 * toxicity.HIDDEN), np.float32)
        gates = np.concatenate((net.p["bx"][None], x)).astype(np.float32)
        want = []
        for a, b in toxicity.windows_of(n):
            at = np.zeros((1, toxicity.WINDOW), np.int64)
            at[0, :b - a] = np.arange(a + 1, b + 1)
            want.append(net.run(gates, at, (at > 0).astype(np.float32))[0])
        assert scorer.logits([" ".join(words)])[0] == pytest.approx(max(want), abs=1e-3)


def test_long_words_are_read_whole():
    assert toxicity.char_rows("antidisestablishmentism") != toxicity.char_rows("antidisestab" + "x" * 12 + "lishmentism")


def test_rows_choose_their_filters_and_come_back():
    r = np.random.default_rng(8)
    data = np.concatenate([r.integers(0, 256, (3, 192)), np.tile(np.arange(192) % 256, (4, 1)), np.full((3, 192), 7), np.repeat(np.arange(5)[:, None] * 50, 192, 1)]).astype(np.uint8)
    stored = media.encode_png(data.tobytes())
    assert (media.decode_png(stored) == data).all()
    for f in (0, 1, 2):
        assert (media.decode_png(media.encode_png(data.tobytes(), f)) == data).all()
    at = stored.index(b"IDAT")
    lines = np.frombuffer(zlib.decompress(stored[at + 4:at + 4 + int.from_bytes(stored[at - 4:at], "big")]), np.uint8).reshape(len(data), -1)
    assert set(lines[:, 0].tolist()) >= {1, 2}
