"""Operators of the third round against the library, brute force and hand-made tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from sealane.llm import filter_audit, phrases, sentence_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, part string, piece int"


def frame(spark, rows):
    """Documents of (doc_id, text, lang, source), with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, None, 1, "k", "p", 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


HOSTILE = [" ", "  ", "▁", "\n", "\t", "é", "the", "ing", "\x00", "�", "😀", "漢", "မ", "a", "xx", "==", "--", " \n", "</s>", "<0x0A>", "<unk>", "ÿ", "00", "tion", "..."]


def test_ids_and_decoded_text_equal_the_library(library):
    rng = random.Random(11)
    texts = ["".join(rng.choice(HOSTILE) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice(pool) for _ in range(50)) for pool in ("ab", " ab\n", "▁ n", "aeiounrst") for _ in range(800)]
    # runs of blanks and signs, whose merges depend on each other, and one word of many rounds
    texts += [" " * n for n in range(0, 400, 7)] + ["x" * 2999, " " * 3000 + "a", "=" * 3001, "漢字" * 1000, "".join(rng.choice("abcdefghij") for _ in range(20_000))]
    found = list(sentence_pieces.Words(sentence_pieces.model_path()).encoded(texts))
    for text, (n, ids, decoded), want in zip(texts, found, library.encode(texts), strict=True):
        assert ids == ",".join(map(str, want)) and n == len(want), text[:80]
        assert decoded == library.decode(want), text[:80]


def test_decoding_any_ids(library):
    rng = random.Random(12)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert sentence_pieces.decode_ids(ids, sentence_pieces.model_path()) == library.decode(ids), ids


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 50)
    monkeypatch.setattr(sentence_pieces, "SYMBOLS", 20)
    monkeypatch.setattr(sentence_pieces, "CHUNK", 100)
    monkeypatch.setattr(sentence_pieces, "ROUNDS", 2)
    texts = ["some words that come again and again", "", "again and more", "x" * 500, "some words"] * 3
    found = sentence_pieces.Words(sentence_pieces.model_path()).encoded(texts)
    assert [ids for _, ids, _ in found] == [",".join(map(str, x)) for x in library.encode(texts)]


def test_round_trip_rows(spark, library):
    rows = [(1, "Hello world", None, None), (1, "Hello world", None, None), (None, "x", None, None), (2, None, None, None), (3, "", None, None), (4, "word " * 30_000, None, None)]
    out = sentence_pieces.round_trip(frame(spark, rows), sentence_pieces.model_path())
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()))) == sorted(map(str, want))
    assert sentence_pieces.round_trip(frame(spark, rows).limit(0), sentence_pieces.model_path()).count() == 0


def mined(rows, top, least):
    """The contract's definitions, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            longer = (x for q, x in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if not any(100 * x >= 50 * a for x in longer):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "new", "york", "city", "é", "ñu", "#", "a-b", "x\x1cy", "漢字", "data"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " : "]) for _ in range(k))
    rows = [(i, text(rng.randint(0, 60)), rng.choice(["en", "en", "en", "fr", None, ""]), None) for i in range(150)]
    rows += [(7, "new york city " * 3000, "en", None), (None, "new york, new york", "en", None), (None, "new york, new york", "en", None), (8, None, "en", None), (9, "", None, None), (9, "of data", "und", None)]
    return rows + [(500, "one two three. " * 40, "xx", None)] * 3 + [(501, "w" * 20_000 + " end " + "w" * 20_000 + " end", "xx", None)]


@pytest.mark.parametrize("bits", [64, 9, 2])
def test_phrases_equal_brute_force_with_and_without_collisions(spark, monkeypatch, bits):
    """Short fingerprints collide everywhere; every count then comes from the text."""
    monkeypatch.setattr(phrases, "FINGERPRINT", np.uint64((1 << bits) - 1))
    monkeypatch.setattr(phrases, "FLUSH", 300)
    rows = phrase_rows()
    found = phrases.best_phrases(frame(spark, rows), top=25, least=4)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == mined(rows, 25, 4)


def test_a_full_filter_and_tables_without_phrases(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 15)
    rows = phrase_rows()
    assert sorted(map(tuple, phrases.best_phrases(frame(spark, rows), top=10, least=2).collect())) == mined(rows, 10, 2)
    assert phrases.best_phrases(frame(spark, rows).limit(0)).count() == 0
    assert phrases.best_phrases(frame(spark, [(1, "a b", "en", None), (2, None, None, None)])).count() == 0


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    known = spark.createDataFrame([(1, "en", "a", big), (1, "en", "b", big + 7), (2, "en", "a b", big - 1), (0, "en", "", 9 * big)], "n int, lang string, phrase string, times long")
    (row,) = phrases.scored(known).collect()
    assert int(row.score) == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def audited(rows, marks):
    """Every order played through, document by document."""
    docs = [(d, t or "", s or "") for d, t, _, s in rows]
    low = {}
    for d, t, _ in docs:
        if d is not None:
            low[t] = min(low.get(t, d), d)
    good = {d for d, q, _ in marks if q == 1 and d is not None}
    toxic = {d for d, _, t in marks if t == 1 and d is not None}

    def fails(d, t):
        words = re.findall("[^\x20\x09-\x0d]+", t)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), t in low and (d is None or low[t] < d)]
        return {f for f, hit in zip("ABCDE", tests, strict=True) if hit}

    parts = defaultdict(list)
    for d, t, s in docs:
        parts[s].append((d, fails(d, t)))
    out = []
    for part, members in parts.items():
        steps, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                failing = [m for m in members if f in m[1]]
                shapley[f] += len(gone)
                steps.append((part, order, step, len(left), len(gone), len(failing) - len(gone), sum(len(m[1]) == 1 for m in failing), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_filter_audit_equals_playing_every_order_through(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "Cd", "e", "F", "g#", "é", "h"]) + str(rng.randint(0, 99))
    texts = [" ".join(word() for _ in range(rng.choice([3, 150, 210, 260]))) for _ in range(40)] + ["same " * 250, "", None, "  \n", "$", "ABC", "x y " * 30_000]
    rows = [(rng.randint(1, 60), rng.choice(texts), None, rng.choice(["s", "s", "s", "t", None, "", "é"])) for _ in range(150)]
    rows += [(None, texts[0], None, "s"), (None, texts[0], None, "s"), (None, "only null ids", None, "n"), (None, "only null ids", None, "n"), (3, "twin", None, "s"), (3, "twin", None, "s"), (3, "twin", None, "t"), (4, "twin", None, "t")]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(1, 50)] + [(5, 0, 0), (5, 1, 1), (None, 1, 1)]
    labelled = spark.createDataFrame([(*m, "s", 1) for m in marks], "doc_id long, quality int, toxic int, source string, n long")
    found = filter_audit.audit(frame(spark, rows), labelled)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == audited(rows, marks)
    assert filter_audit.audit(frame(spark, rows).limit(0), labelled).count() == 0
    assert filter_audit.audit(frame(spark, rows[:5]), labelled.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0
