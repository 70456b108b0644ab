"""The training-data operators against brute force, on tables with every awkward case."""

import base64
import binascii
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fernbase.llm import queries
from fernbase.llm.bpe import Codec, Transducer, Utf8Stream, decode, encode, read_ranks, round_trip
from fernbase.llm.common import Written, fold, free_name, repeatable
from fernbase.llm.decontaminate import ItemAutomaton, clean_documents, contamination_report, find_contamination, pieces_of, without_spans
from fernbase.llm.exact_dedup import exact_dedup, keep_first_copies
from fernbase.llm.fm_index import FMIndex
from fernbase.llm.language import mixtures, predict_languages
from fernbase.llm.quality import accepted, quality_scores
from fernbase.llm.simhash import Counters, carry_save, near_duplicates, near_pairs, one_of_each_group
from fernbase.llm import substring_dedup
from fernbase.llm.substring_dedup import remove_repeats
from fernbase.llm.token_counts import count_tokens, document_token_counts
from fernbase.llm.token_files import ChunkEncoder, find_documents, read_token_orc, token_files, write_token_orc
from fernbase.llm.toxicity import FEATURES, STYLES, Lexicon, toxicity_scores

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is was for on that with as by at from ha ou er th nd ing ly ble".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ly", "er", "s", "."]) for _ in range(n))


def awkward(seed=1):
    """(id, text): nulls, empties, blanks, ties, copies, near copies, repeated rows, shared passages, a long text."""
    rng = random.Random(seed)
    base = [text(rng, rng.choice([3, 20, 60, 130, 300])) for _ in range(30)]
    passage = text(rng, 70)
    rows = list(enumerate(base))
    rows += [(100 + k, t) for k, t in enumerate(base[:8])]
    rows += [(120 + k, t.replace(" ", "\n\t")) for k, t in enumerate(base[5:10])]
    rows += [(140 + k, t[:-3] + "xyz") for k, t in enumerate(base[10:20])]
    rows += [(160 + k, f"{text(rng, 10 + k)} {passage} {text(rng, 5)}") for k in range(6)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "a"), (204, "1"), (205, "ñandú — 漢字 😀 don't"), (206, "x" * 5000), (207, "ab " * 4000)]
    rows += [(0, base[0]), (0, base[0]), (200, None), (None, base[1]), (None, None)]
    rows += [(300, text(rng, 20_000))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have the names that operators use inside."""
    extra = ["place", "fp", "run", "sha", "words", "_id", "row", "n", "score"]
    frame = spark.createDataFrame([(i, t, None, "s", 0, *([7] * len(extra))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{e}` int" for e in extra))
    return frame.repartition(5, F.xxhash64("text", "doc_id"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def norm(t):
    return re.sub(r"[\x20\x09-\x0d]", "", t or "")


def test_exact_dedup(docs, rows, none):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    got = exact_dedup(docs, bits=1).collect()
    assert len(got) == len(rows)
    key = lambda r: (-len(r[1]), r[0] is None, r[0] or 0)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): g for n, g in groups.items()}
    kept = {}
    for r in got:
        g = by_sha[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min(g, key=key)[0]
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup(none).count() == 0
    stay = keep_first_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(norm(r.text) for r in stay.collect()) == sorted(groups)
    assert keep_first_copies(none).count() == 0


def test_runs_stay_sorted(spark, docs):
    """At every level an array for each block, strictly ascending by digest, of at most as many merged arrays as
    runs meet; a round's plan sorts no rows, and the last level holds each digest once."""
    from fernbase.llm import exact_dedup as E

    rows = Written(E.digests(docs.repartition(11)), "digests").df
    levels, answer = E.tree_merge(rows, bits=1, block_rows=4)
    runs = [level.df.select(F.max("run")).first()[0] + 1 for level in levels]
    assert runs == [11, 6, 3, 2, 1] and len({len(level.df.columns) for level in levels}) == 1
    for level in levels:
        for r in level.df.collect():
            keys = [(bytes(e.sha), e.check) for e in r.entries]
            assert keys == sorted(set(keys)) and all(e.n > 0 for e in r.entries)
        assert level.df.select(F.sum(F.expr("aggregate(entries, 0L, (a, e) -> a + e.n)"))).first()[0] == docs.count()
        blocks = level.df.select("run", "block")
        assert blocks.distinct().count() == blocks.count()
    plan = E.merge_round(levels[0].df, 1, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "sha" not in plan.split("Exchange")[1].split("\n")[0]
    assert answer.count() == rows.select("run", "sha").distinct().count()


def simhash(t, size=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, none):
    fps = [simhash(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    want = sorted(((i is None, i or 0), f"{fps[k]:016x}", least.get(label[k])) for k, (i, _) in enumerate(rows))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    assert got == want
    assert near_duplicates(none).count() == 0 and one_of_each_group(none).count() == 0
    left = one_of_each_group(docs).collect()
    assert {r.doc_id for r in left} == set(least.values())


def test_bit_sliced_pairs():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    b = np.concatenate([a[:50] ^ np.uint64(1), a[50:100] ^ np.uint64(5 << 40), a[100:150] ^ np.uint64(7), rng.integers(0, 1 << 63, 33, dtype=np.uint64)])
    for radius in (0, 1, 2, 5):
        i, j = near_pairs(a, b, radius)
        want = {(x, y) for x in range(len(a)) for y in range(len(b)) if int(a[x] ^ b[y]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_carry_save_counters():
    rng = np.random.default_rng(5)
    for most in (0, 1, 2, 3, 4, 7, 9):
        counts, total = Counters(3, most), np.zeros((3, 64), int)
        for k in range(1, 12):
            ones = [rng.integers(0, 1 << 62, 3, dtype=np.uint64) & rng.integers(0, 1 << 62, 3, dtype=np.uint64) for _ in range(k % 5)]
            for one in ones:
                total += np.unpackbits(one.view(np.uint8).reshape(3, 8), axis=1, bitorder="little")
            counts.add(list(ones))
            got = np.unpackbits(counts.beyond().view(np.uint8).reshape(3, 8), axis=1, bitorder="little")
            assert ((total > most) == got).all()
    words = rng.integers(0, 1 << 63, (3, 8), dtype=np.uint64)
    total, carry = carry_save(*words)
    assert [int(a).bit_count() + int(b).bit_count() + int(c).bit_count() for a, b, c in words.T] == [int(s).bit_count() + 2 * int(c).bit_count() for s, c in zip(total, carry)]


def repeats(rows, window=50):
    split = [(i if i is not None else float("inf"), (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for (given, _), (i, w) in zip(rows, split):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((str(given), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1_000_000, 150])
def test_substring_dedup(docs, rows, none, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_WORDS", hot)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs).collect())
    want = repeats(rows)
    assert got == want and sum(w[2] for w in want) > 500
    assert remove_repeats(none).count() == 0


#: Two words that a polynomial hash modulo 2**64 gives one value, whatever its base.
ALIKE = ("sgrsmtdbrzvumtgorzvumtgosgrsmtdbrzvumtgosgrsmtdbsgrsmtdbrzvumtgo", "rzvumtgosgrsmtdbsgrsmtdbrzvumtgosgrsmtdbrzvumtgorzvumtgosgrsmtdb")


def test_words_decide_not_their_hashes(spark):
    """Sequences whose polynomial hashes are equal, and no two windows of which are."""
    signs = [bin(i).count("1") % 2 for i in range(64)]
    pairs = [("8d7f6b0d", "f845e4d0"), ALIKE]
    rows = [(10 * k + j, " ".join(p[t ^ j] for t in signs)) for k, p in enumerate(pairs) for j in (0, 1)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {(r.n_words, r.n_removed) for r in got} == {(64, 0)}


def matching(segments, query):
    """Matching statistics by trying every length."""
    out = []
    for i in range(len(query)):
        n = 0
        while i + n < len(query) and any(query[i : i + n + 1] == s[k : k + n + 1] for s in segments for k in range(len(s) - n)):
            n += 1
        out.append(n)
    return out


def test_matching_statistics():
    rng = np.random.default_rng(2)
    for _ in range(60):
        segments = [rng.integers(1, 4, rng.integers(1, 30)).tolist() for _ in range(rng.integers(1, 6))]
        text = np.array([x for s in segments for x in (*s, 0)])
        query = rng.integers(0, 4, 60)
        query[query > text.max()] = 0
        got = FMIndex(text).statistics(query, np.array([0, 20]), np.array([20, 60])).tolist()
        assert got == matching(segments, query[:20].tolist()) + matching(segments, query[20:].tolist())


def shard(rng, window):
    words = [" ".join(rng.choice("abcabcabcx") for _ in range(rng.randrange(window, 25))).encode() for _ in range(rng.randrange(1, 12))]
    return words, np.array([rng.randrange(3) for _ in words]), np.array([rng.randrange(5) for _ in words])


def test_shard_search(monkeypatch):
    rng = random.Random(6)
    for _ in range(200):
        window = rng.choice([2, 3, 5])
        monkeypatch.setattr(substring_dedup, "CHAIN", rng.choice([1, 2, 128]))
        words, anchor, owner = shard(rng, window)
        cut = [{tuple(w.split()[k : k + window]) for k in range(len(w.split()) - window + 1)} for w in words]
        for j, found in enumerate(substring_dedup.search_shard(words, anchor, owner, window)):
            before = set().union(*(cut[i] for i in range(len(words)) if anchor[i] == anchor[j] and owner[i] < owner[j]))
            mine = words[j].split()
            assert found.tolist() == [k for k in range(len(mine) - window + 1) if tuple(mine[k : k + window]) in before]


def test_nothing_is_found_without_backward_search(monkeypatch):
    words = [b" ".join([b"a", b"b", b"c", b"d"] * 20)] * 2
    find = lambda: substring_dedup.search_shard(words, np.zeros(2), np.arange(2), 50)[1]
    assert len(find()) == 31
    monkeypatch.setattr(FMIndex, "extend", lambda self, symbol, low, high: (low, low))
    assert len(find()) == 0


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 100)
    monkeypatch.setattr(substring_dedup, "MOST_WINDOWS", 30)
    rng = random.Random(3)
    for source in (text(rng, 700), "ab " * 700):
        squeezed = substring_dedup.squeezed(source.encode())
        hashes = substring_dedup.word_hashes(squeezed, *substring_dedup.word_edges(squeezed))
        for gram in (8, 16, 50):
            start, count, _ = substring_dedup.segments(hashes, 50, gram)
            assert sorted(k for s, c in zip(start, count) for k in range(s, s + c)) == list(range(651)) and count.max() <= 30
    long = ("y" * 70 + " \t ") * 3 + "z" * (1 << 20) + " end\n"
    squeezed = substring_dedup.squeezed(long.encode())
    assert squeezed == b" ".join(long.encode().split())
    low, high = substring_dedup.word_edges(squeezed)
    assert [squeezed[a:b] for a, b in zip(low, high)] == long.encode().split() and len(substring_dedup.word_hashes(squeezed, low, high)) == 5
    assert [len(x) for x in substring_dedup.word_edges(b"")] == [0, 0]


NORMAL = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(rows, items, window=13):
    windows = {}
    for i, t in items:
        w = NORMAL.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    named = lambda found: ",".join(sorted(str(x) for x in found if x is not None))
    for i, t in rows:
        w = NORMAL.findall((t or "").encode().lower())
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    found |= s
                    hit[k : k + n] = [1] * n
        out.append((str(i), len(w), sum(hit), len(found), hashlib.sha256(named(found).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block", [200_000, 40])  # the smaller one also cuts items
def test_decontamination(spark, docs, rows, none, block):
    full = [t for _, t in rows if t]
    items = [(1, full[12]), (2, " ".join(full[13].split()[:20])), (3, "Don't"), (10, "the the"), (4, None), (5, "?!"), (6, full[12]), (2, full[3]), (None, full[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(docs, bench, most_words=block)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(x for x in r["items"] if x is not None).encode()).hexdigest(), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found.collect())
    want = contaminated(rows, items)
    assert got == want and any(w[5] for w in want)
    if block > 1000:
        report = contamination_report(docs, bench)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report.collect()) == want
    left = clean_documents(docs, bench, most_words=block)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(w[0] for w in want if not w[5])
    assert clean_documents(none, bench).count() == 0 and contamination_report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_spans(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t in rows if i in (3, 5)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    kept = {r.doc_id: r.kept_text for r in without_spans(docs, find_contamination(docs, bench)).collect()}
    assert kept[3] == "" and len(kept[5].split()) == len(NORMAL.findall(rows[5][1].encode()))


def test_pieces_of_long_items():
    words = [b"%d" % k for k in range(100)]
    for most in (13, 14, 20, 99, 100, 1000):
        pieces = pieces_of(words, 13, most)
        assert max(map(len, pieces)) <= max(13, most)
        assert {tuple(p[k : k + 13]) for p in pieces for k in range(len(p) - 12)} == {tuple(words[k : k + 13]) for k in range(88)}
    assert pieces_of(words[:5], 13, 50) == [words[:5]] and pieces_of([], 13, 50) == [[]]


def test_item_automaton_is_generalised():
    a = ItemAutomaton([("x", [b"a", b"b", b"a"]), ("y", [b"b", b"a", b"b"]), ("z", [b"q"])], 2)
    assert a.scan([b"a", b"b", b"c", b"q", b"b", b"a"]) == ([(0, 2), (3, 6)], {"x", "y", "z"})


RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows, none, reference):
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(docs, RANKS, P.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    assert round_trip(none, RANKS, P.PATTERN).count() == 0
    for clash in ("text", "N", "score"):
        with pytest.raises(ValueError, match="already"):
            encode(docs, RANKS, P.PATTERN, out_col=clash)
    back = decode(encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN, out_col="back").select("text", "back").collect()
    assert all((r.text or "") == r.back for r in back)


def test_transducer_is_exact(reference):
    ranks, rng = read_ranks(RANKS), random.Random(0)
    transducer = Transducer(ranks, most_states=500)
    for k in range(1500):
        alphabet = "abethin grs=- \n.é漢" if k % 2 else "".join(chr(rng.randrange(32, 500)) for _ in range(5))
        piece = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 10, 30, 64, 65, 200]))).encode()
        assert [ranks[t] for t in transducer.tokens(piece)] == reference._core_bpe.encode_single_piece(piece)


def test_arcs_read_whole_texts(spark, reference):
    """Every byte of a piece that is no token goes through an arc; on running text most arcs are there already, and
    most bytes leave before their piece has ended."""
    ranks = read_ranks(RANKS)
    transducer = Transducer(ranks)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    pieces = {p.encode() for t in texts for p in reference_split(t)}
    for p in pieces:
        assert b"".join(transducer.tokens(p)) == p
    new = sum(len(p) for p in pieces if p not in ranks)
    assert transducer.read == new and transducer.made < 0.3 * new and transducer.early > 0.5 * new


def reference_split(text):
    import regex

    return regex.findall(P.PATTERN, text)


def test_words_that_share_a_hash(tokenizer, reference):
    codec, encoder = Codec(RANKS, P.PATTERN), ChunkEncoder(P.path("word_bpe_49k.json"))
    for word in (*ALIKE, *ALIKE, " ".join(ALIKE)):
        assert codec.encode(word) == reference.encode_ordinary(word)
        assert encoder.encode([word.encode()])[0].tolist() == tokenizer.encode(word, add_special_tokens=False).ids


def test_results_do_not_change_at_the_sizes_where_ways_do(spark, tokenizer, reference, monkeypatch):
    """Pieces around the length that tables keep, texts around the length that is cut all at once, words around the
    length that another hash takes, texts around the length that is cut into parts: the same results."""
    rng = random.Random(9)
    codec, encoder = Codec(RANKS, P.PATTERN), ChunkEncoder(P.path("word_bpe_49k.json"), most_bytes=400)
    words = ["".join(rng.choice("etaoinshrd") for _ in range(n)) for n in (63, 64, 65, 99, 100, 101, 127, 128, 129) for _ in range(2)]
    for w in (*words, *words, " ".join(words)):
        assert codec.encode(w) == reference.encode_ordinary(w)
        ids, counts = encoder.encode([w.encode(), (w + " x").encode()])
        assert ids.tolist() == tokenizer.encode(w, add_special_tokens=False).ids + tokenizer.encode(w + " x", add_special_tokens=False).ids
    for size in (2 * 8 * 40 - 1, 2 * 8 * 40, 2 * 8 * 40 + 1):
        t = " ".join(words)[:size]
        got = [list(map(int, ids.split())) for ids, _ in codec.encode_all([t.encode(), b"a b"], most_bytes=80)]
        assert got == [reference.encode_ordinary(t), reference.encode_ordinary("a b")]
    for size in (399, 400, 401):
        t = " ".join(words)[:size]
        assert encoder.encode([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    passage = " ".join(w[:n] for w, n in zip(words * 4, (62, 63, 64, 65, 66) * 20))
    rows = [(1, passage), (2, f"x {passage} y"), (3, f"{'z' * 64} {passage[:-1]}")]
    monkeypatch.setattr(substring_dedup, "MOST_WINDOWS", 7)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == repeats(rows) and got[1][2] == len(passage.split())


def test_codec_tables_may_be_small(reference):
    codec, rng = Codec(RANKS, P.PATTERN, bits=6), random.Random(1)
    texts = ["".join(rng.choice("abAB  \n\t..,12é'sl É× 漢") for _ in range(rng.randrange(80))) for _ in range(400)]
    for t, (ids, n) in zip(texts, codec.encode_all([t.encode() for t in texts])):
        want = reference.encode_ordinary(t)
        assert list(map(int, ids.split())) == want and n == len(want)


def test_utf8_stream():
    rng = random.Random(4)
    for _ in range(300):
        data = "aé漢😀".encode() * 2 if rng.random() < 0.5 else bytes(rng.randrange(256) for _ in range(12))
        stream, out, at = Utf8Stream(), "", 0
        while at < len(data):
            n = rng.randrange(1, 4)
            out += stream.feed(data[at : at + n])
            at += n
        assert out + stream.finish() == data.decode("utf-8", "replace")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_token_files(spark, docs, rows, none, tokenizer, tmp_path):
    want, start = [], 0
    coded = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows]
    crc = lambda ids: binascii.crc32(np.array(ids, "<u4").tobytes())
    tie = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    for (i, t), ids in sorted(zip(rows, coded), key=lambda x: (x[0][0] is not None, x[0][0] or 0, tie(x[0][1]))):
        want.append((str(i), start, len(ids), crc(ids)))
        start += len(ids)
    path = f"file://{tmp_path}/orc"
    write_token_orc(docs, path, P.path("word_bpe_49k.json"), 2)
    got = [(str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in read_token_orc(spark, path).collect()]
    assert sorted(got) == sorted(want)
    assert token_files(none, P.path("word_bpe_49k.json"), 2).count() == 0
    found = {r.doc_id: r.ids for r in find_documents(spark, path, [5, 300, 999]).collect()}
    assert found == {i: ids for (i, _), ids in zip(rows, coded) if i in (5, 300)}


def rows_read(df):
    """Rows that the scan of a frame gives to its filter."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_token_files_are_pruned_by_metadata(spark, tmp_path):
    """Even ids in files with a row index every 1000 rows: ranges exclude all row groups but one, and for an odd id
    inside a range the Bloom filter excludes that one too."""
    path, n = f"file://{tmp_path}/orc", 20_000
    docs = spark.range(0, 2 * n, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"))
    write_token_orc(docs, path, P.path("word_bpe_49k.json"), 2)
    assert rows_read(spark.read.orc(path)) == n
    assert find_documents(spark, path, [4242]).count() == 1
    assert 0 < rows_read(find_documents(spark, path, [4242])) <= 1000
    assert rows_read(find_documents(spark, path, [-1, 10**9])) == 0
    assert sum(rows_read(find_documents(spark, path, [k])) > 0 for k in range(4001, 4101, 2)) <= 5


def test_an_id_that_many_rows_share_is_spread(spark, tmp_path):
    path = f"file://{tmp_path}/orc"
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows in one file
    write_token_orc(docs, path, P.path("word_bpe_49k.json"), 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.orc(path).where("doc_id IS NULL").select("_metadata.file_name").distinct().count()
    assert files > 1
    got = sorted((r.start, r.n_tokens) for r in read_token_orc(spark, path).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and len(got) == 3000


def test_chunk_encoder_is_the_library(tokenizer):
    rng = random.Random(3)
    letters = [chr(c) for c in range(1, 0x250)] + list("''sstm..  ́̈漢字ΣİΑ  😀") + [" "] * 12
    texts = ["".join(rng.choice(letters) for _ in range(50)) for _ in range(1500)] + ["", " ", "a" * 300, "x" * 99 + " " + "y" * 100]
    for options in ({}, {"bits": 8, "most_bytes": 60}):
        encoder = ChunkEncoder(P.path("word_bpe_49k.json"), **options)
        ids, counts = encoder.encode([t.encode() for t in texts])
        at = 0
        for t, n in zip(texts, counts):
            assert ids[at : at + n].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
            at += n


def test_strings_of_special_tokens(tokenizer):
    texts = ["a <|endoftext|> b", "x<|startoftext|>Y É<|endoftext|>é", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>", "<|endoftext", "<|endoftext|>"]
    encoder, plain = (ChunkEncoder(P.path("word_bpe_49k.json"), plain_text=p) for p in (False, True))
    for t in texts:
        assert encoder.encode([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        tokenizer.encode_special_tokens = True
        assert plain.encode([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        tokenizer.encode_special_tokens = False
    assert encoder.encode([b"a <|endoftext|> b"])[0].tolist() == [320, 49407, 321]


def test_token_counts(docs, rows, none, tokenizer):
    got = sorted((str(r.doc_id), r.n_tokens) for r in document_token_counts(docs, P.path("word_bpe_49k.json"), 49407).collect())
    assert got == sorted((str(i), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert document_token_counts(none, P.path("word_bpe_49k.json"), 49407).count() == 0


@pytest.mark.parametrize("block", [2, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    rng, want = np.random.default_rng(0), []
    for k, n in enumerate([0, 1, 5, 100, 700, 16, 17]):
        ids = rng.integers(0, 5 if k % 2 else 30, n).astype("<u2")
        ids.tofile(tmp_path / f"f{k}.bin")
        ordinal = start = 0
        for i, v in enumerate(ids.tolist()):
            if v == 3:
                want.append((f"f{k}.bin", ordinal, start, i - start, True))
                ordinal, start = ordinal + 1, i + 1
        if start < n:
            want.append((f"f{k}.bin", ordinal, start, n - start, False))
    assert sorted(tuple(r) for r in count_tokens(spark, f"file://{tmp_path}", 3, 2, block).collect()) == sorted(want)


def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def accuracy(scored, labels, column):
    both = scored.where("held_out").join(labels, "doc_id")
    return both.select(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_quality(spark, docs, none):
    documents, labels = labelled(spark)
    assert accuracy(quality_scores(documents, labels), labels, "quality") > 0.95
    some = quality_scores(docs, labels).collect()
    assert len(some) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in some)
    assert quality_scores(none, labels).count() == 0 and accepted(none, labels).count() == 0
    one = quality_scores(documents, labels.where("quality = 1")).agg(F.min("score"), F.max("score")).first()
    assert one[0] == one[1] > 0.9 and quality_scores(documents, labels.limit(0)).first().score == 0.5
    assert accepted(documents, labels).count() == quality_scores(documents, labels).where("predicted = 1").count()


def plain_statistics(t):
    """The twelve statistics, a character or word at a time."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
    n = len(words)
    if not n:
        return [0.0] * 12
    chars = [c for w in words for c in w]
    every = (t or "").encode()
    upper, lower, digits = (sum(a <= c <= b for c in every) for a, b in ((65, 90), (97, 122), (48, 57)))
    sign = lambda c: c < 128 and not (chr(c).isalnum() or c in b" \t\n\x0b\f\r")
    visible = lambda c: sign(c) and 0x20 < c < 0x7F
    lines = [x for x in every.split(b"\n") if x.split()]
    ratio = lambda a, b: math.sqrt(a / b)
    return [
        math.log(1 + n), math.log(len(chars) / n), ratio(upper, upper + lower + 1), ratio(sum(map(sign, every)), len(chars)),
        ratio(sum(a == b and visible(a) for a, b in zip(every, every[1:])), n), ratio(every.count(b"|"), n), ratio(every.count(b"!"), n), ratio(digits, len(chars)),
        ratio(sum(a == b for a, b in zip(words, words[1:])), n), math.log(len(set(words)) / n) / math.log(n + 9), math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0, ratio(every.count(b"."), n),
    ]


def plain_quality(rows, labels, shrink=0.3, diagonal=0.1):
    """The posterior of class 1 by densities written out."""
    stats = [(i, np.array(plain_statistics(t))) for i, t in rows]
    known = [(y, x) for i, x in stats for j, y in labels if i == j and binascii.crc32(str(j).encode()) % 4 != 2]
    by = [np.array([x for y, x in known if y == c]) for c in (0, 1)]
    prior = (len(by[1]) + 1) / (len(known) + 2)
    spread = [sum(np.outer(x - b.mean(0), x - b.mean(0)) for x in b) for b in by]
    pooled = (spread[0] + spread[1]) / len(known)
    pooled = np.array([[v * (1 if i == j else 1 - diagonal) for j, v in enumerate(row)] for i, row in enumerate(pooled)]) + 1e-6 * np.eye(12)
    cov = [(1 - shrink) * s / len(b) + shrink * pooled for s, b in zip(spread, by)]
    out = []
    for i, x in stats:
        logs = [math.log(p) - 0.5 * (x - b.mean(0)) @ np.linalg.solve(c, x - b.mean(0)) - 0.5 * math.log(np.linalg.det(c)) for p, b, c in zip((1 - prior, prior), by, cov)]
        out.append((str(i), 1 / (1 + math.exp(min(500, max(-500, logs[0] - logs[1]))))))
    return sorted(out)


def test_quality_is_the_plain_discriminant(spark, rows, docs):
    """Scores against densities written out, on running texts and on awkward ones."""
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "quality", "toxic")
    both = spark.createDataFrame([*real, *rows], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.score, r.held_out, r.predicted) for r in quality_scores(both, labels).collect())
    want = plain_quality([*real, *rows], [(r.doc_id, r.quality) for r in labels.collect()])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert all(p == (s >= 0.7) and h == (i != "None" and binascii.crc32(i.encode()) % 4 == 2) for i, s, h, p in got)
    stay = accepted(both, labels).collect()
    assert sorted(str(r.doc_id) for r in stay) == [w[0] for w in want if w[1] >= 0.7]


def plain_lexicon(rows, labels, least_odds=2.3):
    sets = {y: {frozenset(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in rows if labels.get(i) == y} for y in (0, 1)}
    count = {y: Counter(w for s in sets[y] for w in s) for y in sets}
    total = {y: sum(map(len, sets[y])) for y in sets}
    least = max(min(5, len(sets[1])), len(sets[1]) // 200)
    odds = lambda a, b: math.log((a + 0.5) / total[1]) - math.log((b + 0.5) / total[0])
    every = set(count[0]) | set(count[1])
    words = {w: odds(count[1][w], count[0][w]) for w in every if count[1][w] >= least}
    starts = {}
    for w in every:
        for k in range(4, 9):
            if len(w) > k:
                starts.setdefault(w[:k], []).append((count[1][w], count[0][w]))
    begun = {}
    for b, x in starts.items():
        a = sum(v for v, _ in x)
        if a >= 2 * least and max(v for v, _ in x) < 0.5 * a and (o := odds(a, sum(v for _, v in x))) >= least_odds:
            begun[b] = o
    kept = {b: o for b, o in begun.items() if not any(b[:k] in begun and begun[b[:k]] >= o - 1 for k in range(4, len(b)))}
    return {w: o for w, o in words.items() if o >= least_odds}, kept


def plain_label_model(votes, weights):
    """The tree model from weighted rows: (prior, parent, table) by counting pairs one by one."""
    v = len(votes[0])
    pairs = np.zeros((2, v, 2, v, 2))
    for row, w in zip(votes, weights):
        for j in range(v):
            for k in range(v):
                for y in (0, 1):
                    pairs[y, j, row[j], k, row[k]] += w[y]
    total = [sum(w[y] for w in weights) + 1 for y in (0, 1)]
    p = [(pairs[y] + 0.25) / (total[y] + 1) for y in (0, 1)]
    alone = [[[p[y][j][a][j][a] / (p[y][j][0][j][0] + p[y][j][1][j][1]) for a in (0, 1)] for j in range(v)] for y in (0, 1)]

    def shared(j, k):
        out = 0.0
        for y in (0, 1):
            size = sum(p[y][j][a][k][b] for a in (0, 1) for b in (0, 1))
            out += total[y] / sum(total) * sum(p[y][j][a][k][b] / size * math.log(p[y][j][a][k][b] / size / alone[y][j][a] / alone[y][k][b]) for a in (0, 1) for b in (0, 1))
        return out

    info = {(j, k): shared(j, k) for j in range(v) for k in range(v)}
    parent, inside = {0: None}, [0]
    while len(inside) < v:
        j, k = max(((j, k) for j in range(v) if j not in parent for k in inside), key=info.get)
        parent[j] = k
        inside.append(j)

    def posterior(row):
        logs = []
        for y in (0, 1):
            log = math.log(total[y] / sum(total))
            for j, k in parent.items():
                log += math.log(alone[y][j][row[j]] if k is None else p[y][j][row[j]][k][row[k]] / (p[y][j][0][k][row[k]] + p[y][j][1][k][row[k]]))
            logs.append(log)
        return 1 / (1 + math.exp(min(500, max(-500, logs[0] - logs[1]))))

    return posterior


def plain_toxicity(rows, labels):
    known = {}
    for i, y in labels:
        if i is not None and binascii.crc32(str(i).encode()) % 5:
            known[i] = max(y, known.get(i, 0))
    lexicon = Lexicon(*plain_lexicon(rows, known))
    read = [lexicon.read(t or "") for _, t in rows]
    votes, x = [r[0] for r in read], np.array([r[1] for r in read])
    label = [known.get(i) for i, _ in rows]
    model = plain_label_model([v for v, y in zip(votes, label) if y is not None], [(1 - y, y) for y in label if y is not None])
    target = lambda: [model(v) if y is None else y for v, y in zip(votes, label)]
    for _ in range(4):
        model = plain_label_model(votes, [(1 - t, t) for t in target()])
    t, w = np.array(target()), np.zeros(x.shape[1])
    for _ in range(8):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(len(w)), x.T @ (t - p) - w)
        w = w + step * min(1, 5 / max(1e-9, abs(step).max()))
        if abs(step).max() < 1e-4:
            break
    return sorted((str(i), 1 / (1 + math.exp(-float(f @ w))), model(v)) for (i, _), v, f in zip(rows, votes, x))


def test_toxicity_is_the_plain_model(spark, rows):
    """Scores and label posteriors against lexicon, label model and regression by plain loops."""
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "quality", "toxic")
    known = [(r.doc_id, r.toxic) for r in labels.collect()]
    both = [*real, *rows]
    got = sorted((str(r.doc_id), r.score, r.label_posterior, r.held_out, r.predicted) for r in toxicity_scores(spark.createDataFrame(both, "doc_id long, text string"), labels).collect())
    want = plain_toxicity(both, known)
    assert [g[0] for g in got] == [w[0] for w in want] and len({w[1] > 0.5 for w in want}) == 2
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-6)
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)
    assert all(p == (s >= 0.5) and h == (i != "None" and binascii.crc32(i.encode()) % 5 == 0) for i, s, _, h, p in got)


def test_toxicity(spark, docs, none):
    documents, labels = labelled(spark)
    scored = toxicity_scores(documents, labels).cache()
    assert accuracy(scored, labels, "toxic") > 0.93
    assert scored.where("score < 0 OR score > 1 OR (score >= 0.5) != (predicted = 1)").count() == 0
    assert toxicity_scores(docs, labels).count() == docs.count()
    assert toxicity_scores(none, labels).count() == 0
    assert toxicity_scores(documents, labels.limit(0)).first().score == 0.5


def style(lexicon, text, name):
    """The vote of one of the styles on a text."""
    votes, _ = lexicon.read(text)
    return votes[len(votes) - len(STYLES) + STYLES.index(name)]


def test_disguised_words_beside_other_signs():
    lexicon = Lexicon({"idiot": 3.0, "asshole": 3.0}, {})
    found = ["1d10t", "1d10t-faced", "you/1d10t", "1d10t's", "well—1d10t—yes", "“1d10t”", "1d10t…", "<b>1d10t</b>", "_1d10t_", "`1d10t`", "(1D10T),", "«a$$h0le»", "@sshole!"]
    lost = ["idiot", "idiot 10", "idiot-10", "1d10ts", "x1d10t", "1d1 0t", "", "漢字1d10t"]
    assert [t for t in found if not style(lexicon, f"so {t} then", "masked")] == []
    assert [t for t in lost if style(lexicon, f"so {t} then", "masked")] == []
    # against the search over the whole text
    search = re.compile(r"[^\W_]*[0134578@$][^\W_@$]*(?:[0134578@$][^\W_@$]*)*")
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["1d10t", "idiot", "a$$", "hole", "@", "0", "9", "x", "_", "-", "'", "—", " ", "\n", "É"]) for _ in range(8))
        want = {m.translate(str.maketrans("0134578@$", "oieastbas")) for m in search.findall(text.lower())} & lexicon.words.keys()
        assert style(lexicon, text, "masked") == bool(want), text


def test_beginnings_are_counted_at_every_size():
    lexicon = Lexicon({"bad": 3.0}, {"zorg": 3.0})
    for types in (1, 49, 50, 51, 200):
        words = [f"zorg{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(types)]
        text = " ".join(words * 20 + ["bad"] * 30 + ["plain"] * (40_000 - 20 * types))
        n = 40_031
        _, features = lexicon.read(text)
        assert features[FEATURES.index("beginning_rate")] == pytest.approx((20 * types / n) ** 0.5)
        assert features[FEATURES.index("word_rate")] == pytest.approx((30 / n) ** 0.5)
        assert style(lexicon, text, "beginning_rate") == (20 * types > 0.01 * n)


def test_capitals_of_the_whole_text_are_counted():
    lexicon = Lexicon({}, {})
    for times in (10, 200, 2000):
        assert style(lexicon, "aBCDEFG" * times, "shouting") and style(lexicon, "éÀÉÎ " * times, "shouting")
        assert not style(lexicon, "Abcdefg" * times, "shouting") and not style(lexicon, "Ab" * times, "shouting")
        assert style(lexicon, "Ab" * times + "C", "shouting")


def test_language(spark, docs, none):
    documents, _ = labelled(spark)
    got = predict_languages(documents).join(documents.select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97
    some = {r.doc_id: r for r in predict_languages(documents.select(*none.columns).unionByName(docs.select(*none.columns).where("doc_id >= 200"))).where("doc_id >= 200").collect()}
    assert {some[i].lang_pred for i in (201, 202, 204)} == {"und"}
    assert predict_languages(none).count() == 0 and predict_languages(docs).select("lang_pred").distinct().collect()[0][0] == "und"


def test_letters_are_of_category_l(spark):
    """Numbers that are no digits, marks and signs are no letters; letters without case are."""
    rows = [(k, t) for k, t in enumerate(["½ ² Ⅷ", "①②", "_ ! 12", "́", "ª", "ʰ", "漢", "é", "Z", "12 x"])]
    learnt = [(100 + k, t, lang) for k in range(20) for t, lang in (("the house on the hill", "en"), ("das haus auf dem berg", "de"))]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows] + learnt, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in predict_languages(docs).where("doc_id < 100").collect()}
    assert [got[k].lang_pred == "und" for k, _ in rows] == [True] * 4 + [False] * 6
    assert all(got[k].score == 0 for k in range(4))


def plain_languages(rows, share=0.02, steps=10):
    """The mixtures by plain loops: doc -> (language, proportion)."""
    def grams(t):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (t or "").encode())
        b = b"  " + b + b"  "
        codes = [b[k - 1] << 16 | b[k] << 8 | b[k + 1] for k in range(1, len(b) - 1) if b[k] != 32]
        return Counter((c * 2654435761 % (1 << 32)) >> 20 for c in codes)

    learnt = [(grams(t), lang) for i, t, lang in rows if lang is not None and t is not None and binascii.crc32(str(i).encode()) % 3 != 1]
    names = sorted({lang for _, lang in learnt})
    model = {}
    for name in names:
        total = Counter()
        for g, lang in learnt:
            if lang == name:
                total.update(g)
        n = sum(total.values()) + 0.5 * 4096
        model[name] = [(total[k] + 0.5) / n for k in range(4096)]

    def fit(g, chosen):
        p = {c: 1 / len(chosen) for c in chosen}
        n = max(1, sum(g.values()))
        for _ in range(steps):
            new = dict.fromkeys(chosen, 0.0)
            for k, m in g.items():
                mixed = sum(p[c] * model[c][k] for c in chosen)
                for c in chosen:
                    new[c] += m * p[c] * model[c][k] / mixed
            p = {c: v / n for c, v in new.items()}
        return p, sum(m * math.log(sum(p[c] * model[c][k] for c in chosen)) for k, m in g.items())

    def single(g):
        scores = {c: sum(m * math.log(model[c][k]) for k, m in g.items()) for c in names}
        best = max(names, key=lambda c: scores[c])
        return best, scores[best]

    unit = lambda g: 0.5 * math.log(max(sum(g.values()), 2))
    needed = []
    for g, _ in learnt:
        best, like = single(g)
        full, _ = fit(g, names)
        second = max((c for c in names if c != best), key=lambda c: full[c])
        needed.append(min(100.0, max(0, math.ceil((fit(g, [best, second])[1] - like) / unit(g) / 0.25) * 0.25)))
    penalty = max(1.0, next(v for v in (k * 0.25 for k in range(401)) if sum(x > v for x in needed) <= share * len(needed)))
    out = {}
    for i, t, _ in rows:
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            out[i] = ("und", 0.0)
            continue
        g = grams(t)
        best, like = single(g)
        chosen, p = [best], {best: 1.0}
        full, _ = fit(g, names)
        while len(chosen) < len(names):
            rest = max((c for c in names if c not in chosen), key=lambda c: full[c])
            if full[rest] <= 0.01:
                break
            trial, more = fit(g, [*chosen, rest])
            if more - like <= penalty * unit(g):
                break
            chosen, p, like = [*chosen, rest], trial, more
        first = max(sorted(p), key=lambda c: p[c])
        out[i] = (first, p[first] / sum(p.values()))
    return out


def test_language_is_the_plain_mixture(spark):
    """The query's predictions against plain loops over documents of one and of two languages."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900 OR text IS NULL").limit(60).collect()]
    by = {}
    for _, t, lang in rows:
        if lang and t:
            by.setdefault(lang, []).append(t)
    pairs = [" ".join(x) for x in zip(*[by[k] for k in sorted(by)[:2]])][:10]
    rows += [(10_000 + k, t, None) for k, t in enumerate([*pairs, None, "", "½ ²", "x"])]
    want = plain_languages(rows)
    got = predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = want[r.doc_id]
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=0.005)


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(0)
    model = rng.dirichlet(np.full(4096, 0.05), 3)
    counts = np.stack([rng.multinomial(400, model[1]), rng.multinomial(200, model[0]) + rng.multinomial(200, model[2])])
    shares = mixtures(counts, model + 1e-9, 8.0)
    assert shares[0].argmax() == 1 and (shares[0] > 0).sum() == 1
    assert abs(shares[1] - [0.5, 0, 0.5]).max() < 0.1


def test_folds_match_crc32(spark):
    ids = spark.range(200).withColumn("held", fold("id", 5, 0)).collect()
    assert all(r.held == (binascii.crc32(str(r.id).encode()) % 5 == 0) for r in ids)


def test_only_repeatable_plans_are_read_twice(spark):
    """Files filtered by plain expressions keep their rows' places; anything else is written first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copied = lambda df: repeatable(df) is not df
    assert not copied(docs) and not copied(docs.where("doc_id > 5").select("doc_id", F.upper("text")))
    assert copied(docs.where(F.rand(1) < 0.5)) and copied(docs.withColumn("x", F.monotonically_increasing_id())) and copied(docs.repartition(3)) and copied(docs.limit(5))
    assert copied(docs.mapInArrow(lambda it: it, docs.schema)) and copied(spark.createDataFrame(docs.limit(3).collect(), docs.schema))


def test_free_name(spark):
    assert free_name(spark.createDataFrame([(1, 2)], "row int, ROW_ int"), "row") == "row__"


def test_pipeline_stages(spark):
    """Each stage against brute force on what the stage before it kept."""
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = [r.asDict() for r in kept.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, kept, SF)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r.doc_id for r in got.collect()}
        if name == "exact_dedup":
            best = {}
            for r in seen:
                best.setdefault(norm(r["text"]), []).append((-len(r["text"] or ""), r["doc_id"]))
            assert left == {min(v)[1] for v in best.values()}
        if name == "near_dedup":
            fps = {r["doc_id"]: simhash(r["text"]) for r in seen}
            ids, gone = sorted(fps), set()
            label = {i: i for i in ids}
            for _ in ids:
                before = dict(label)
                for a in ids:
                    for b in ids:
                        if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                            label[a] = label[b] = min(label[a], label[b])
                if before == label:
                    break
            gone = {i for i in ids if label[i] != i}
            assert left == set(ids) - gone
        if name == "decontamination":
            assert left == {int(w[0]) for w in contaminated([(r["doc_id"], r["text"]) for r in seen], bench) if not w[5]}
        seen = [r for r in seen if r["doc_id"] in left]
        kept = kept.where(F.col("doc_id").isin(list(left)))
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {r["doc_id"] for r in seen}
    assert all(r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r in out for t in [next(x["text"] for x in seen if x["doc_id"] == r.doc_id)])


def test_pipeline_on_awkward_tables(spark, rows, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows and copies through all stages; and an empty table. Every text
    kept is one of the input's, no two are alike but for blanks, and none is contaminated."""
    tables = {name: spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels", "benchmark")}
    columns = tables["documents"].columns
    awkward_rows = spark.createDataFrame([(i if i is None else i + 10_000, t, None, None, None) for i, t in rows], tables["documents"].schema)
    for name, documents in (("some", tables["documents"].unionByName(awkward_rows)), ("none", none.select(*columns))):
        folder = f"{tmp_path}/{name}"
        documents.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            tables[t].write.parquet(f"{folder}/{t}.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        if name == "none":
            assert out == []
            continue
        texts = {}
        for r in documents.collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        digests = {i: {hashlib.sha256(t.encode()).hexdigest(): t for t in ts} for i, ts in texts.items()}
        left = [digests[r.doc_id][r.decoded_sha256] for r in out]
        assert len(left) > 20 and len({norm(t) for t in left}) == len(left)
        bench = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
        assert not any(w[5] for w in contaminated(list(enumerate(left)), bench))


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
