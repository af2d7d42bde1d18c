import random
import re

import numpy as np
import pytest

from tessera.llm import suffix_automaton as sa


def brute(doc, ref, width):
    known = {tuple(ref[i : i + width]) for i in range(len(ref) - width + 1)}
    gone = np.zeros(len(doc), dtype=bool)
    for i in range(len(doc) - width + 1):
        if tuple(doc[i : i + width]) in known:
            gone[i : i + width] = True
    return gone.tolist()


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    ref, doc = ([rng.randrange(3) for _ in range(rng.randrange(60))] for _ in range(2))
    built = sa.automaton(ref)
    for width in (1, 3, 6):
        assert sa.covered(sa.matching(doc, built), width).tolist() == brute(doc, ref, width)


def test_reference_passages_go(spark, monkeypatch):
    monkeypatch.setattr(sa, "SHARD_WORDS", 12)
    rng = random.Random(9)
    ref = [" ".join(rng.choice("abc") for _ in range(40)), None, "", "a b"]
    texts = [(i, "\n".join(" ".join(rng.choice("abc") for _ in range(30)) for _ in range(2))) for i in range(30)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    reference = spark.createDataFrame([(t,) for t in ref], "text string")
    out = {r.doc_id: r for r in sa.remove_reference_passages(docs, reference, 5).collect()}
    for i, t in texts:
        words = re.findall(r"\S+", t or "")
        gone = brute(words, re.findall(r"\S+", ref[0]), 5)
        assert out[i].n_removed == sum(gone)
        assert re.findall(r"\S+", out[i].text or "") == [w for w, g in zip(words, gone) if not g]
    monkeypatch.setattr(sa, "MAX_WORDS", 10)
    with pytest.raises(ValueError):
        sa.remove_reference_passages(docs, reference, 5)
