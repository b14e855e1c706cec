"""Language identification against sets of trigrams without a filter."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import language_id
from tests.llm.fixtures import table


def grams(text):
    """Letters lower-cased, each run of other characters one mark, one at either end; a leading run counts for none."""
    chars, out = [], ""
    for c in (text or "").lower():
        if c.isalpha():
            chars.append(c)
        elif chars and chars[-1] != "#":
            chars.append("#")
    out = ["#", *chars, "#"]
    return ["".join(out[i : i + 3]) for i in range(len(out) - 2)] if chars else []


def brute(learned, texts, least=3, share=0.4):
    counts = defaultdict(Counter)
    for lang, text in learned:
        counts[lang].update(grams(text))
    part = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = Counter()
    for p in part.values():
        for g, x in p.items():
            most[g] = max(most[g], x)
    held = {lang: {g for g, x in part[lang].items() if x >= share * most[g] and counts[lang][g] >= least} for lang in part}
    out = []
    for text in texts:
        found = grams(text)
        hits = {lang: sum(g in held[lang] for g in found) for lang in sorted(held)}
        best = max(sorted(hits), key=lambda x: hits[x]) if found else "und"
        alone = not found or list(hits.values()).count(hits[best]) == 1
        out.append((best, hits[best] / sum(hits.values()) if found and sum(hits.values()) else 0.0, alone))
    return out


def test_predictions_equal_those_of_sets(spark):
    rng = random.Random(21)
    letters = {"aa": "aeioukstnr", "bb": "aeiouplmgd", "cc": "äöüéèplst", "dd": "aeiukstlm"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7)))
    rows = []
    for i in range(400):
        lang = rng.choice(list(letters))
        text = rng.choice(["", "12 ", "  "]) + rng.choice([" ", ", ", "\n", " 7 "]).join(word(lang if rng.random() < 0.9 else "dd") for _ in range(rng.randint(1, 60)))
        rows.append((i, text, lang if i % 9 else None, None, 1, "x", "y", "z", 1, False, "q"))
    rows += [(900 + k, t, "aa", None, 1, "x", "y", "z", 1, False, "q") for k, t in enumerate([None, "", "123 !!", "é", "Ä", "qqqq"])]
    learned = [(r[2], r[1]) for r in rows if r[2] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    want = dict(zip([r[0] for r in rows], brute(learned, [r[1] for r in rows]), strict=True))
    got = language_id.predict_languages(table(spark, rows), per_language=10**6).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score, alone = want[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=0.01), r["doc_id"]
        if alone:
            assert r["lang_pred"] == lang, r["doc_id"]


def test_the_filter_forgets_no_trigram_and_corrects_its_count():
    rng = np.random.default_rng(4)
    held = np.unique(rng.integers(0, 1 << 62, 30_000, np.uint64))
    languages = tuple(f"l{i:02d}" for i in range(70))  # more than one word of bits
    masks = np.zeros((len(held), 2), np.uint64)
    owner = rng.integers(0, 70, len(held))
    masks[np.arange(len(held)), owner // 64] = np.uint64(1) << (owner % 64).astype(np.uint64)
    model = language_id.LanguageFilter.of(languages, held, masks, slots=1 << 14)
    found = model.masks(held)
    assert ((found & masks) == masks).all()
    foreign = rng.integers(1 << 62, 1 << 63, 50_000, np.uint64)
    rate = model.false_rates()
    seen = model.masks(foreign)
    for i in (0, 33, 69):
        assert abs(((seen[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() - rate[i]) < 0.01
