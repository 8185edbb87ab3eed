"""Each operator against a brute-force version, on texts that hold the edge cases."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from claimstead.llm import bpe_fst, chat_format, hilbert_neighbours, induced_sort, language_id, packing, parity_join, personal_data, quality_rules, suffix_dedup, token_store  # noqa: E402
from claimstead.llm.pieces import pack  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
rnd = random.Random(5)
WORDS = ["the", "of", "engine", "naïve", "Straße", "don't", "x+y", "日本", "a", "river", "stone", "light"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


TEXTS = [None, "", " ", "one", "a\n\n  b\t", "\x1c x\x85 y", prose(80, 1), prose(80, 1), prose(80, 1) + " end", "Y " * 400, prose(3000, 2), prose(300, 3), "q" * 30000]
ROWS = [(i if i % 7 else None, t, "en" if i % 2 else None, 1.5) for i, t in enumerate(TEXTS, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def key(row):
    return row[0] is None, row[0] or 0


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids


def test_token_store(docs, empty):
    got = sorted(map(tuple, token_store.store_documents(docs, VOCABULARY).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    start = 0
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in ordered]
    sums = {}
    for r in ROWS:
        ids = pack([*library(r[1]), 2])
        sums.setdefault(r[0], []).append((len(ids) // 4, zlib.crc32(ids)))
    for doc_id, at, n, crc in got:
        assert at == start and (n, crc) in sums[doc_id]
        start += n
    assert token_store.store_documents(empty, VOCABULARY).count() == 0


def test_crc_of_parts():
    parts = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 7, 300, 4096)]
    assert token_store.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_chunks_follow_content():
    ids = np.array([rnd.randrange(50000) for _ in range(20000)], np.uint32)
    ends = token_store.cut_points(ids)
    assert ends[-1] == 20000 and max(np.diff([0, *ends])) <= token_store.LONGEST
    moved = token_store.cut_points(np.concatenate([ids[:5], [9], ids[5:]]))
    assert len({e + 1 for e in ends} & set(moved)) > 0.8 * len(ends)


def test_packing(docs, empty):
    rows = packing.best_fit_pack(docs, VOCABULARY).collect()
    assert all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    total = sum(len(library(r[1])) + 1 for r in ROWS)
    assert sum(r.length for r in rows) == total
    assert packing.best_fit_pack(empty, VOCABULARY).count() == 0


def test_open_sequences_take_the_fullest():
    o = packing.OpenSequences(10, places=2)
    assert [o.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert o.place(5) == (2, 0) and o.place(4) == (0, 6)
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(3) == [(0, 3)]


def test_transducer_is_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe_fst.codec(path, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_fst.load_ranks(path), special_tokens={})
    parts = ["a", "th", "ing", " ", "  ", "\n", "é", "日", "ж", "1", "23", ".", "!", "'s", "🚀", "\t", "\x1c"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(500)]
    for t in texts:
        ids = both.encode(t)
        assert ids == pack(library.encode_ordinary(t))
        assert both.decode(memoryview(ids).cast("I")) == t.encode()
    for _ in range(500):
        piece = bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 12)))
        assert both.transducer.encode(piece) == bpe_fst.merge_by_rank(piece, both.transducer.ranks) or piece in both.transducer.ranks


def test_stream_decoder_ends_between_characters():
    both = bpe_fst.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    stream, out = bpe_fst.StreamDecoder(both.transducer.bytes_of), b""
    for i in memoryview(both.encode("日本é🚀x" * 5)).cast("I"):
        part = stream.feed([i])
        part.decode()
        out += part
    assert out + stream.finish() == ("日本é🚀x" * 5).encode()


def test_encode_decode(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe_fst.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for t in TEXTS)


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "\\[INST]", "a\\\\</s>", "end\\", " <s>", "[ROLE] x [AS]", "<<SYS>>", "\n\n"])
@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool [AS]", ""])
def test_chat_round_trip(role, text):
    written, start, end = chat_format.format_turn(role, text)
    assert [t[:2] for t in chat_format.parse(written * 2)] == [(role, text)] * 2
    assert chat_format.unescape(written[start:end]) == (text if role == "assistant" else "")


def test_chat_query(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "</s> b"), (None, 0, None, "x"), (2, 5, "assistant", "z")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_formatted(chat_format.format_conversations(conversations)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 6
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\n</s> b\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"</s> b").hexdigest()
    assert got[None].n_turns == 1 and got[2].loss_chars == 1
    assert chat_format.read_formatted(chat_format.format_conversations(conversations.limit(0))).count() == 0


def test_quality_counts(docs):
    from collections import Counter

    got = quality_rules.quality_rules(docs).collect()
    expected = Counter()
    for _, t, _, _ in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, same = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                same += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        expected[len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), same, len(repeated), failed] += 1
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)


def test_jensen_shannon():
    a, b = np.array([1.0, 0]), np.array([0, 2.0])
    assert quality_rules.jensen_shannon(a, b) == 1 and quality_rules.jensen_shannon(a, a) == 0


def test_quality_of_table(empty):
    assert quality_rules.quality_rules(empty).count() == 0


def test_personal_data(spark):
    texts = ["mail a.b@c.de, x@y.z_d@e.f and @h.i", "1.2.3.4.5.6.7.8 at 300.1.1.1 and 001.2.3.4", "card 4111 1111 1111 1111, 4111111111111112", "+1 (555) 010-2000 or +12", "IBAN GB82 WEST 1234 5698 7654 32", "my ssn 123-45-6789", "9" * 20000, "a@" * 5000, None, ""]
    got = personal_data.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = got.withColumn("list", personal_data.span_list(F.col("spans"))).withColumn("masked", personal_data.masked(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    for r in rows:
        base = []
        for rank, (kind, rx) in enumerate(personal_data.BASE.items()):
            for m in re.finditer(rx, r.text):
                digits = re.sub(r"\D", "", m[0])
                doubled = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
                if ok:
                    base.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        kept = [x for x in r.list.split(",") if x.split(":")[0] in personal_data.BASE]
        assert kept == [x[2] for x in sorted(base)]
    assert rows[4].list == "iban:5:32" and rows[5].list == "ssn:7:18" and rows[5].masked == "my ssn <SSN>"


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    vectors += [(i, [1.0] * 8) for i in range(300, 340)] + [(20, vectors[20][1]), (21, vectors[21][1]), (404, [2.0, 1.0])]  # ties, repeated rows, a short one
    good = [(i, np.array([*v, *[0] * (8 - len(v))], np.float32).astype(float)) for i, v in vectors]
    vectors += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] * 4), (None, [1.0] * 8)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {}
    for r in hilbert_neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for at, (q, v) in enumerate(good[:340]):
        if q % 20 == 0:
            best = sorted((-(v @ w), i) for k, (i, w) in enumerate(good) if k != at)[:20]
            assert got[q] == [i for _, i in best]
    assert hilbert_neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("queries", [16384, 20])
def test_nearest_outside_the_windows(spark, monkeypatch, queries):
    monkeypatch.setattr(hilbert_neighbours, "QUERIES", queries)
    vectors = np.random.default_rng(2).normal(size=(1200, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in hilbert_neighbours.nearest(frame, F.col("vec_id") % 20 == 0, orderings=2, block=32, margin=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    scores = vectors[::20].astype(float) @ vectors.T.astype(float)
    for q, row in zip(range(0, 1200, 20), scores, strict=True):
        assert got[q] == [i for i in np.lexsort((np.arange(1200), -row)) if i != q][:20]


def test_hilbert_keys_walk_to_neighbours():
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    path = cells[np.argsort(hilbert_neighbours.hilbert_keys(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_language_id(spark):
    samples = {"en": "the river runs over stones and the light", "de": "der Fluss läuft über die Steine und das Licht", "fr": "la rivière coule sur les pierres et la lumière"}
    rows = [(i, " ".join(random.Random(i).sample(samples[lang].split(), 6)), lang) for i in range(120) for lang in [list(samples)[i % 3]]]
    rows += [(200, None, "en"), (201, "12 %", "de"), (None, "the light", None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows[:120] if got[r[0]].held_out]
    assert held and all(zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in held)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.9 * len(held)
    assert got[200].lang_pred == got[201].lang_pred == "und" and got[None].lang_pred == "en"
    nothing = language_id.language_id(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")).first()
    assert nothing.lang_pred == "und"


def test_codewords_are_apart():
    m = language_id.code(20)
    assert min((m[i] != m[j]).sum() for i in range(20) for j in range(i)) >= 10


def shingle_sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def linked_components(rows, size, percent):
    """The smallest index of a row of each row's component, by comparing all pairs."""
    sets = list(shingle_sets(list(enumerate(t for _, t in rows)), size).values())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(rows))], [len(x) for x in sets]


def families(seed, sizes, copies, ids):
    r = random.Random(seed)
    rows = []
    for n in sizes:
        base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(n)]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randrange(0, max(1, len(words) // 15) + 1)):
                words[r.randrange(len(words))] = "new"
            if r.random() < 0.3:
                words = words[r.randrange(len(words) // 8 + 1) :]
            rows.append((ids(len(rows)), " ".join(words)))
    return rows


@pytest.mark.parametrize(("size", "percent", "popular"), [(4, 85, 16), (5, 80, 2), (2, 60, 3)])
def test_parity_join(spark, monkeypatch, size, percent, popular):
    monkeypatch.setattr(parity_join, "POPULAR", popular)
    monkeypatch.setattr(parity_join, "TILE", 8 if popular < 16 else 2048)
    monkeypatch.setattr(parity_join, "CELL", 3)
    # ids that are null or stand on several rows, copies, blanks, and a line that most documents share
    rows = families(popular, (7, 8, 12, 25, 40, 60, 200, 200, 900), 14, lambda k: None if k % 9 == 0 else k * 3 // 2)
    line = " ".join(f"common{k}" for k in range(40))
    rows += [(1000 + k, line + " " + prose(30 + k, k)) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "One two"), (2003, "one TWO"), (2004, "x"), (2004, "x"), (2005, " \t ")]
    label, n = linked_components(rows, size, percent)
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min((k for k in (least.get(x), i) if k is not None), default=None)
    expected = sorted(((i, k, least[x]) for (i, _), k, x in zip(rows, n, label, strict=True)), key=str)
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, node string, th int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in parity_join.similar_documents(docs, size, percent).collect()), key=str)
    assert got == expected
    assert parity_join.similar_documents(docs.limit(0), size, percent).count() == 0


def similar(x, y, percent=85):
    both = len(np.intersect1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def chained(n):
    """Texts (a, b, c): a-b and b-c link, a-c does not, and every key of both b and c is one of a."""
    r, found = random.Random(17), []
    while len(found) < n:
        tag, w = r.randrange(10**9), r.randrange(20, 40)
        b = [f"{tag}w{k}" for k in range(w)]
        c = ["new"] * r.randrange(1, 4) + b[r.randrange(3) :]
        texts = [" ".join(x) for x in (b[: -r.randrange(1, 4)], b, c)]
        sets = [parity_join.shingles(t, 4) for t in texts]
        if parity_join.node_of(sets[0]) < parity_join.node_of(sets[1]) and [similar(sets[i], sets[j]) for i, j in ((0, 1), (1, 2), (0, 2))] == [True, True, False]:
            keys = [set(parity_join.block_keys(x, 85)[0].tolist()) for x in sets]
            if keys[1] & keys[2] <= keys[0]:
                found.append(texts)
    return found


def test_parity_join_across_tasks_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "FLUSH", 1)
    triples = chained(60)
    firsts, lasts = [t for a, b, _ in triples for t in (a, b)], [c for *_, c in triples]
    # the first half in one task, which flushes after every 1000 rows; the second half in two tasks
    parts = [firsts[:60] + [""] * 940 + lasts[:30], firsts[60:], lasts[30:]]
    rows = [[(k * 10_000 + i, t) for i, t in enumerate(part)] for k, part in enumerate(parts)]
    first = {t: i for part in rows for i, t in part}
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).flatMap(lambda part: part), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in parity_join.similar_documents(docs, 4, 85).collect()}
    lost = [t for t in triples if len({got[first[x]] for x in t}) > 1]
    assert lost == []


def test_bands_hold_all_pairs():
    b = parity_join.bands(85)
    for n in range(6, 400):
        for m in range(n, 100 * n // 85 + 1):
            if b.most_apart(n, m) >= m - n and b.groups(n) and b.groups(m):
                shared = {g for g, *_ in b.groups(n)} & {g for g, *_ in b.groups(m)}
                assert shared and any(d >= b.most_apart(n, m) for g, d, _ in b.groups(n) if g in shared)


def covered(texts, length):
    places = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i : i + length], []).append((k, i))
    marks = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                marks[k][i : i + length] = b"\1" * length
    return marks


def test_suffix_dedup(spark):
    passage, other = prose(120, 11), prose(60, 12)
    texts = [prose(100, 20) + passage + prose(50, 21), prose(10, 22) + passage, other + prose(5, 23), "é" + other, "Y " * 500, prose(40, 24), prose(40, 24), None, "", "abcabc" * 100 + prose(60, 25), prose(70, 26) + passage[17:290] + "z"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    data = [(t or "").encode() for t in texts]
    marks = covered(data, 200)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n string"), ["doc_id"]).collect()
    for r in got:
        t, m = data[r.doc_id], marks[r.doc_id]
        left = bytes(c for c, gone in zip(t, m, strict=True) if not gone)
        runs = len(re.findall(b"\1+", bytes(m)))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(m), runs, hashlib.sha256(left).hexdigest())
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).count() == 0


def test_hot_contexts_are_counted(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    passage = prose(60, 31)
    texts = [prose(30, 40 + i) + passage + prose(30, 60 + i) for i in range(8)]
    marks = covered([t.encode() for t in texts], 200)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: sum(m) for i, m in enumerate(marks)}


def test_induced_order():
    for trial in range(60):
        letters = rnd.choice(["ab", "a", "abcdefgh"])
        segments = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 40))).encode() for _ in range(rnd.randrange(1, 8))]
        text = induced_sort.joined(segments)
        ends = np.flatnonzero(text == 0)
        end = lambda i: ends[np.searchsorted(ends, i)]  # noqa: B023, E731
        expected = sorted((i for i in range(len(text)) if text[i]), key=lambda i: (text[i : end(i)].tobytes() + b"\0", end(i)))
        assert list(induced_sort.suffix_order(text, induced_sort.words_at(text), resident=rnd.choice([1, 1 << 20]))) == expected


def test_induced_order_of_some_places():
    for trial in range(40):
        text = induced_sort.joined([bytes(rnd.choice(b"aab") for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 8))])
        wanted = np.array([rnd.random() < 0.5 for _ in text])
        words = induced_sort.words_at(text)
        whole = induced_sort.suffix_order(text, words)
        assert list(induced_sort.suffix_order(text, words, wanted)) == [i for i in whole if wanted[i]]


class _Contexts:
    """Stands for the table of contexts, to run what its tasks run in this process."""

    def repartition(self, *columns):
        return self

    sortWithinPartitions = repartition  # noqa: N815

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def _context_batches(anchors, each, shared, rows):
    """Contexts of 336 bytes, a few to an anchor; those of one anchor have their middle in common."""
    r, out = random.Random(8), []
    letters = bytes(range(97, 123)) + b"  "
    some = lambda n: bytes(r.choices(letters, k=n))
    for h in range(anchors):
        middle, side = some(shared), (336 - shared) // 2
        for c in range(each):
            edge = bytes([65 + c])
            out.append((h, c, h * each + c, 5000, 7, 1, False, some(side - 1) + edge + middle + edge + some(335 - shared - side)))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    table = pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["h", "c", "th", "n", "first", "times", "hot", "data"])
    return table.to_batches(max_chunksize=rows)


def test_shard_sort_is_frugal():
    batches = _context_batches(4000, 5, 240, 10_000)  # 6.4 MiB
    run = suffix_dedup._sorted_shards(_Contexts(), 200)
    list(run(iter(batches[:1])))  # whatever is imported or made once
    tracemalloc.start()
    try:
        found = sum((b.num_rows for b in run(iter(batches))), 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == 20_000
    assert peak < 64 << 20


def test_shards_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    found = []
    for rows in (1, 3, 7, 1000):
        run = suffix_dedup._sorted_shards(_Contexts(), 200)
        batches = _context_batches(12, 4, 250, rows)
        twice = [b for batch in batches for b in (batch, batch.slice(batch.num_rows - 1))]  # a row of a copy follows
        found.append(sorted(tuple(r.values()) for b in run(iter(twice)) for r in b.to_pylist()))
    assert found[0] == [(k, 5000, 7 + 43, 7 + 43 + 250) for k in range(48)]
    assert all(x == found[0] for x in found)
