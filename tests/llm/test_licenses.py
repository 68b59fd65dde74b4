"""Licence notices against a comparison of every passage with every template."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import licenses
from marginalia.llm.queries import QUERIES

SCHEMA = "doc_id long, page_idx int, text string"


def bigrams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return Counter(zip(words, words[1:], strict=False))


def slow(text, templates, least):
    lines = re.split(r"\r\n|\r|\n", text or "")
    blocks = [b for b in re.split(r"\n\s*\n", "\n".join(line if re.search(r"[^\W_]", line) else "" for line in lines)) if b.strip()]
    passages = [line for line in lines if re.search(r"[^\W_]", line)]
    passages += [b for b in blocks if b.strip("\n").count("\n")]
    passages += [text] if len(blocks) > 1 else []
    best, places = {}, Counter()
    for passage in passages:
        own, seen = bigrams(passage), set()
        for name, template in templates:
            other = bigrams(template)
            if own and other:
                dice = 2 * (own & other).total() / (own.total() + other.total())
                if dice >= least:
                    seen.add(name)
                    best[name] = max(best.get(name, 0), dice)
        places.update(seen)
    return sorted((name, places[name], best[name]) for name in best)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_pages(spark, least):
    pick, rows = random.Random(6), []
    for i in range(150):
        lines = [" ".join(pick.choice(["alle", "rights", "the", "License", "x"]) for _ in range(pick.randint(0, 9))) for _ in range(pick.randint(0, 5))]
        for _ in range(pick.randint(0, 2)):
            words = pick.choice(licenses.TEMPLATES)[1].split()
            for _ in range(pick.randint(0, 3)):
                words[pick.randrange(len(words))] = pick.choice(["other", "word", "THE"])
            cut = pick.randint(0, len(words))
            lines[0:0] = [pick.choice([" ".join(words), " ".join(words).upper()])] if pick.random() < 0.5 else [
                " ".join(words[:cut]), " ".join(words[cut:]), pick.choice(["", " -- "])]
        rows.append((i, 0, pick.choice(["\n", "\r\n"]).join(lines)))
    rows += [(900, 0, None), (901, 0, ""), (902, 1, "MIT"), (None, None, "All rights\nreserved."), (903, 0, "all rights reserved"),
             (903, 0, "all rights reserved"), (904, 0, "all rights reserved " * 100_000)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("license_id", F.lit(1)).withColumn("best_dice", F.lit("x"))
    found = sorted(map(tuple, licenses.licensed_pages(table, min_dice=least).collect()), key=repr)
    assert found == sorted(((d, p, *hit) for d, p, t in rows for hit in slow(t, licenses.TEMPLATES, least)), key=repr)
    assert len({name for _, _, name, *_ in found}) > 10


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.licensed_pages(empty).count() == 0
    one = spark.createDataFrame([(1, 0, "All rights reserved.")], SCHEMA)
    assert licenses.licensed_pages(one, []).count() == 0
    assert licenses.licensed_pages(one, [("x", ""), ("y", "word")]).count() == 0
    with pytest.raises(ValueError):
        licenses.licensed_pages(one, min_dice=0)


def test_notices_within_passages(spark, tmp_path):
    """As the query finds them: in longer lines, over lines of a block, in long texts, and side by side."""
    pick = random.Random(9)
    prose = lambda n: " ".join("".join(pick.choices("bcdfg", k=6)) for _ in range(n))
    texts = dict(licenses.TEMPLATES)
    gpl = "This work is licensed under the GNU General Public License, version 3."
    wrapped = texts["MIT"].split()
    rows = {1: ("Copyright (c) 2020 Example Corp. All rights reserved.", [("proprietary", 1, 1.0)]),
            2: (f"{prose(9)}. {gpl} {prose(9)}.", [("GPL-3.0", 1, 1.0)]),
            3: (prose(60) + "\n" + " ".join(wrapped[:30]) + "\n" + " ".join(wrapped[30:]) + "\n" + prose(5), [("MIT", 1, 1.0)]),
            4: (f"{prose(5000)} {gpl} {prose(5000)} {gpl} {prose(50)}", [("GPL-3.0", 2, 1.0)]),
            5: ("All rights reserved.\nAll rights reserved by Example. " + prose(8), [("proprietary", 2, 1.0)]),
            6: (f"{prose(9)} {' '.join(texts['Apache-2.0'].split()[:-2])} {prose(9)}", None),
            7: ("All rights reserved, " * 3 + prose(20), [("proprietary", 3, 1.0)]),
            8: (f"{prose(9)} all {prose(1)} rights {prose(9)}", [])}
    (spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")
     .write.parquet(str(tmp_path / "documents.parquet")))
    found = {}
    for doc, *hit in map(tuple, QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()):
        found.setdefault(doc, []).append(tuple(hit))
    apache = found.pop(6)
    assert [(name, places) for name, places, _ in apache] == [("Apache-2.0", 1)] and apache[0][2] > 0.9
    found = {i: [hit for hit in hits if hit[2] == 1.0] for i, hits in found.items()}  # without other versions of the GPL
    assert found == {i: hits for i, (_, hits) in rows.items() if hits}


def test_stretches_against_every_window():
    pick = random.Random(10)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    short = [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) < 9]
    for _ in range(300):
        words = "x y".split()
        for _ in range(pick.randint(1, 4)):
            own = pick.choice(short)[1].split()
            own[pick.randrange(len(own))] = pick.choice(["other", "the", own[0]])
            words += own[:pick.randint(1, len(own))] + ["z"] * pick.randint(0, 2)
        text = " ".join(words)
        words = licenses.normal_words(text).split()
        near = {name for i in range(len(words)) for j in range(i + 2, min(len(words), i + 70) + 1)
                for name in scanner.matches(" ".join(words[i:j]))}
        assert {name for name, *_ in scanner.notices(text, True)} == near
