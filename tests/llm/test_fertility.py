from __future__ import annotations

import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from quillspark.llm.fertility import judge, measure

from .conftest import frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
BOTH = (PATH, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def prose(seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice("the cat and dog went home quickly over some old green hills near water before night came".split()) for _ in range(120))


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_and_measures(docs, pairs):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for _, t in pairs:
        ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for i in model.encode(w)]
        row = brute(t or "")
        if ids:
            h = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
            row += (round(row[1] / len(ids), 6), round(sum(map(model.is_byte, ids)) / len(ids), 6), round(abs(h) / math.log2(min(len(ids), 32000)), 6) if len(ids) > 1 else 0.0)
        else:
            row += (None, None, None)
        want.append(row)
    six = lambda x: None if x is None else round(x, 6) + 0.0
    got = [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], six(r["chars_per_token"]), six(r["byte_share"]), six(r["entropy"])) for r in measure(docs, *BOTH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_second_vocabulary(docs, pairs):
    import tiktoken

    from quillspark.llm.bpe import load_ranks

    ranks = load_ranks(BOTH[1])
    coder = tiktoken.Encoding("x", pat_str=BOTH[2], mergeable_ranks=ranks, special_tokens={})

    def broken(i):
        try:
            return coder.decode_single_token_bytes(i).decode() is None
        except UnicodeDecodeError:
            return True

    want = []
    for _, t in pairs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        ids = [i for w in words for i in coder.encode_ordinary(f" {w}")]
        want.append((round(sum(map(len, words)) / len(ids), 6), round(sum(map(broken, ids)) / len(ids), 6)) if ids else (None, None))
    six = lambda x: None if x is None else round(x, 6)
    got = [(six(r["pair_chars_per_token"]), six(r["pair_byte_share"])) for r in measure(docs, *BOTH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_verdicts_equal_a_plain_version(spark):
    """Bands and verdicts from the measures, by sorting all of them."""
    from quillspark.llm.fertility import MEASURES

    rnd = random.Random(12)
    junk = " | ".join("".join(rnd.choice("bcdfghjkmpqvwxz") for _ in range(5)) for _ in range(90))
    rows = [(i, prose(i), "en") for i in range(60)] + [(100 + i, korean(i), "ko") for i in range(7)] + [(200, junk, "en"), (201, korean(50), "en"), (202, prose(99), "fr"), (203, "short", "en"), (204, None, None)]
    got = tagged(spark, rows).collect()
    assert {r["id"] for r in got if r["failed_band"]} >= {200, 201}
    for r in got:
        own = [x for x in got if x["lang"] == r["lang"] and not x["base_failed"] and x["n_tokens"]]
        failed = []
        for m, (part, flat) in MEASURES.items():
            at = sorted(math.floor(x[m] * 10_000 + 0.5) for x in own)
            if at and r[m] is not None:
                q1, q3 = (at[math.ceil(q * len(at)) - 1] / 10_000 for q in (0.25, 0.75))
                wide = part * 3.0 * (q3 - q1) + flat * (math.exp(-len(at) / 100) if q3 > q1 else 1.0)
                if not q1 - wide <= r[m] <= q3 + wide:
                    failed.append(m)
        assert r["failed_band"] == (failed[0] if failed else None) and r["kept"] == (not r["base_failed"] and not failed), r


def test_bands_reject_outliers_only(spark, none):
    good = [(i, prose(i)) for i in range(150)]
    odd = [(1000, " ".join(chr(0x1F600 + i % 60) + chr(0x13000 + i) for i in range(80))), (1001, None), (1002, "word " * 99)]
    got = {r["id"]: r for r in judge(frame(spark, good + odd), *BOTH).collect()}
    assert all(got[i]["kept"] for i, _ in good)
    assert not got[1000]["kept"] and got[1000]["failed_band"] is not None and not got[1000]["base_failed"]
    assert got[1001]["base_failed"] and got[1002]["base_failed"] and not got[1002]["kept"]
    assert judge(none, *BOTH).count() == 0


def test_small_languages_take_the_common_band(spark):
    df = frame(spark, [(i, prose(i)) for i in range(20)])
    assert all(r["kept"] for r in judge(df, *BOTH).collect())


def test_bands_reject_junk_and_keep_good_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = judge(docs, *BOTH).where("not base_failed").join(labels, F.col("id") == F.col("doc_id")).groupBy("quality").agg(F.count("*"), F.count_if("kept"))
    got = {r[0]: r[1:] for r in judged.collect()}
    junk, junk_kept, good, good_kept = *got[0], *got[1]
    assert junk_kept < 0.6 * junk and good_kept > 0.99 * good


def test_bands_reject_rows_of_single_words(spark):
    rnd = random.Random(5)
    junk = [(1000 + i, " | ".join("".join(rnd.choice("bcdfghjkmpqvwxz") for _ in range(5)) for _ in range(90))) for i in range(5)]
    got = {r["id"]: r for r in judge(frame(spark, [(i, prose(i)) for i in range(150)] + junk), *BOTH).collect()}
    assert all(got[i]["failed_band"] == "chars_per_token" and not got[i]["base_failed"] for i, _ in junk)
    assert all(got[i]["kept"] for i in range(150))


def tagged(spark, rows):
    return judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *BOTH)


def korean(seed: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(chr(rnd.randint(0xAC00, 0xD7A3)) for _ in range(rnd.randint(2, 4))) for _ in range(120))


def test_a_small_language_is_judged_alike_at_every_count(spark):
    latin = [(1000 + i, prose(i), "en") for i in range(300)]
    for code in ("ko", None):
        for n in (3, 99, 100):
            got = {r["id"]: r for r in tagged(spark, latin + [(i, korean(i), code) for i in range(n)]).collect()}
            assert all(got[i]["kept"] for i in range(n)), (code, n)


def test_codes_without_subtags_and_unknown_ones_by_script(spark):
    rows = [(0, prose(0), "pt-BR"), (1, prose(1), "PT_pt"), (2, prose(2), "zh-Hans"), (3, prose(3), None), (4, korean(4), "und"), (5, "1 2 3", "x"), (6, None, None)]
    got = {r["id"]: r["lang"] for r in tagged(spark, rows).collect()}
    assert got == {0: "pt", 1: "pt", 2: "zh", 3: "und-latin", 4: "und-hangul", 5: "und", 6: "und"}
