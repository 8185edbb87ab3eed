"""Operators and the pipeline against plain loops, on fixtures that hold the edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from claimstead.llm import chat_format, language_id, packing, quality_rules, queries  # noqa: E402
from tests.llm.test_operators import VOCABULARY, covered, library, linked_components  # noqa: E402


def words_of(r, n, letters):
    return ["".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(n)]


LETTERS = {"aa": "abcdefgh", "bb": "ijklmnopß", "cc": "qrstuvéè", None: "abyzж"}


def corpus(seed, n):
    r = random.Random(seed)
    common = {lang: words_of(r, 30, letters) for lang, letters in LETTERS.items()}
    rows = []
    for i in range(n):
        lang = r.choice(list(LETTERS))
        own = common[lang] + words_of(r, 40, LETTERS[lang])
        text = "".join(r.choice(own).capitalize() + r.choice([" ", " ", ", ", ".\n", " 12 "]) for _ in range(r.choice([3, 40, 60, 120, 300])))
        rows.append((i, text, lang))
    rows += [(n, None, "aa"), (n + 1, "", None), (n + 2, "12 ?", "bb"), (n + 3, "#$% " * 90, "cc"), (n + 4, "ж " * 400, "aa"), (None, rows[3][1], "aa"), (None, rows[3][1], "aa")]
    return rows


def test_codewords_against_a_plain_loop(spark):
    rows = corpus(3, 120)
    docs = spark.createDataFrame([(i, t, lang, "x", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    got = sorted(((r.doc_id, r.held_out, r.lang_pred) for r in language_id.language_id(docs).collect()), key=str)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i, *_ in rows]
    profiles, seen = {}, set()
    for (_, text, lang), out in zip(rows, held, strict=True):
        counts = language_id.ngram_counts(text)
        if not out and lang and text is not None and counts is not None and (lang, text) not in seen:
            seen.add((lang, text))
            profiles[lang] = profiles.get(lang, 0) + 1000 * counts / counts.sum()
    model = language_id.Model(profiles)
    expected = []
    for (i, text, _), out in zip(rows, held, strict=True):
        counts = language_id.ngram_counts(text)
        best = "und"
        if counts is not None:
            said = [language_id.SHARPNESS * sum(counts[k] * model.weights[k, b] for k in np.flatnonzero(counts)) / counts.sum() for b in range(model.code.shape[1])]
            loss = [sum(math.log1p(math.exp(-s * c)) * w for s, c, w in zip(said, word, model.trust, strict=True)) for word in model.code]
            best = model.languages[loss.index(min(loss))]
        expected.append((i, out, best))
    assert got == sorted(expected, key=str)


def plain_classes(text):
    n = [0] * 9
    for c in text:
        kinds = [c in "abcdefghijklmnopqrstuvwxyz", c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ", c in "0123456789", c in " \t\r\x0b\x0c", c == "\n", c in ".,;:!?'\"()-", c in "#*$%&|<>", ord(c) > 127]
        n[kinds.index(True) + 1 if True in kinds else 0] += 1
    return n


def plain_distance(a, b):
    p, q = ([x / sum(h) for x in h] for h in (a, b))
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda u: sum(x * math.log2(x / z) for x, z in zip(u, m, strict=True) if x)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def plain_quality(rows):
    """index -> (kept, base failed)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    bucket = lambda w: zlib.crc32(w.encode()) % quality_rules.BUCKETS
    classes, times = defaultdict(lambda: [0] * 9), defaultdict(Counter)
    for (_, text, lang), ws in zip(rows, words, strict=True):
        classes[lang] = [a + b for a, b in zip(classes[lang], plain_classes(text or ""), strict=True)]
        times[lang].update(map(bucket, ws))
    references = {}
    for lang, n in times.items():
        if n:
            common = sorted(n, key=lambda b: (-n[b], b))[: quality_rules.COMMON]
            references[lang] = classes[lang], common, [*(n[b] for b in common), sum(n.values()) - sum(n[b] for b in common)]
    out = []
    for (_, text, lang), ws in zip(rows, words, strict=True):
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        again = set()
        for k in range(len(ws) - 2):
            if grams[ws[k], ws[k + 1], ws[k + 2]] > 1:
                again |= {k, k + 1, k + 2}
        failed = len(ws) < 50 or 100 * len(again) > 50 * len(ws)

        def near(reference, ws=ws, text=text):
            by_class, common, by_word = reference
            own = Counter(map(bucket, ws))
            shared = [own[b] for b in common]
            ok = sum(by_class) == 0 or len(text) < 200 or plain_distance(plain_classes(text), by_class) <= quality_rules.MOST_CLASS
            return ok and (len(ws) < 50 or plain_distance([*shared, len(ws) - sum(shared)], by_word) <= quality_rules.MOST_WORD)

        out.append((not failed and any(map(near, references.values())), failed))
    return out


def test_divergence_against_a_plain_loop(spark):
    rows = corpus(5, 60)
    docs = spark.createDataFrame([(i, t, lang, 1, "k") for i, t, lang in rows], "doc_id long, text string, lang string, n_words int, kept string").repartition(5)
    got = sorted(((r.doc_id, r.kept, r.base_failed) for r in quality_rules.quality_rules(docs).collect()), key=str)
    verdicts = plain_quality(rows)
    assert got == sorted(((i, *v) for (i, *_), v in zip(rows, verdicts, strict=True)), key=str)
    assert {k for k, _ in verdicts} == {True, False}


def test_pieces_against_the_library(spark):
    rows = [*corpus(7, 12), (99, "word " * 5000, None), (99, "word " * 5000, None)]
    docs = spark.createDataFrame([(i, t, 3, "p") for i, t, _ in rows], "doc_id long, text string, length int, piece string").repartition(3)
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.best_fit_pack(docs, VOCABULARY).collect()), key=str)
    expected = []
    for i, text, _ in rows:
        ids = [*library(text), 2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if k == 0 else start + 1024]
            expected.append((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert got == sorted(expected, key=str)


def test_conversations_read_back(spark, tmp_path):
    r = random.Random(2)
    parts = ["</s>", "[INST]", " ok ", "[/INST]", "\\", "<s>", "é", "\n", "x"]
    rows = [(c, t, "assistant" if t % 2 else "user", None if r.random() < 0.1 else "".join(r.choice(parts) for _ in range(r.randrange(12)))) for c in range(40) for t in range(r.randrange(1, 7))]
    rows += [(500, 0, "user", "long " * 200_000), (500, 1, "assistant", "[/INST]" * 100_000)]
    spark.createDataFrame([(*x, "k") for x in rows], "conv_id long, turn long, role string, text string, loss_chars string").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in queries.op7_chat_format(spark, str(tmp_path)).collect()}
    hard = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for c, _, role, text in sorted([*rows, (-7, 0, "user", hard), (-7, 1, "assistant", hard)], key=lambda x: x[:2]):
        turns[c].append((role, text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = {c: "".join(t for role, t in x if role == "assistant") for c, x in turns.items()}
    # the joined conversation reads as its turns
    joined = defaultdict(list)
    for x in chat_format.format_conversations(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect():
        joined[x.conv_id].append((x.position, x.formatted))
    for c, x in joined.items():
        assert [t[:2] for t in chat_format.parse("".join(t for _, t in sorted(x)))] == turns[c]
    assert got == {c: (len(x), digest("".join(f"{role}\n{t}\n" for role, t in x)), len(loss[c]), digest(loss[c])) for c, x in turns.items()}


def test_pipeline_against_plain_loops(spark, tmp_path):
    r = random.Random(11)
    vocabulary = {lang: words_of(r, 60, letters) for lang, letters in LETTERS.items() if lang}
    prose = lambda lang, n: [r.choice(vocabulary[lang]) for _ in range(n)]
    passage = " ".join(prose("aa", 60))
    texts = []
    for _ in range(12):
        lang = r.choice(list(vocabulary))
        base = prose(lang, r.choice([60, 120, 260]))
        for k in range(r.choice([1, 1, 3])):
            words = list(base)
            for _ in range(k):
                words[r.randrange(len(words))] = "new"
            texts.append((" ".join(words), lang))
    texts += [(" ".join(prose("bb", 80)) + " " + passage + " " + " ".join(prose("bb", 70)), "bb") for _ in range(3)]
    texts += [("mail ann.bee@corvel.example now " + " ".join(prose("cc", 90)), "cc"), ("too short", "aa"), (None, "bb"), ("same same same " * 60, "aa")]
    rows = [(10 * (len(texts) - i) + 3, t, lang) for i, (t, lang) in enumerate(texts)]
    docs = spark.createDataFrame([(*x, "s", 1, "extra") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, label string")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [x for x, (ok, _) in zip(rows, plain_quality(rows), strict=True) if ok]
    roots, _ = linked_components([(i, t) for i, t, _ in kept], 5, 80)
    least = {root: min(kept[k][0] for k in range(len(kept)) if roots[k] == root) for root in set(roots)}
    kept = sorted(x for x in kept if x[0] in least.values())
    data = [t.encode() for _, t, _ in kept]
    left = [bytes(b for b, gone in zip(d, marks, strict=True) if not gone).decode(errors="ignore") for d, marks in zip(data, covered(data, 200), strict=True)]
    assert any(len(a) < len(b) for a, b in zip(left, data, strict=True)) and len(kept) < len(rows) - 4
    counts = {i: len(library(re.sub(r"ann\.bee@corvel\.example", "<EMAIL>", t))) + 1 for (i, *_), t in zip(kept, left, strict=True)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed = Counter()
    for x in got:
        packed[x.doc_id] += x.length
    assert packed == counts
