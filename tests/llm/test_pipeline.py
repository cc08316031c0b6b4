import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

import __spark_entry__
import corpus_pipeline
from quarrystone.llm import toxicity
from quarrystone.llm.common import table, written
from quarrystone.llm.tokens import Encoder

from .test_mixing import plain_targets
from .test_simhash import plain_components, plain_fingerprint
from .test_tokens_packing import check_packing


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ba", "den", "ko", "ril", "su", "ta"]) for _ in range(rng.randrange(1, 4)))
    passage = " ".join(word() for _ in range(120))
    rows = []
    for i in range(160):
        words = [word() for _ in range(rng.randrange(20, 90))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["numbskull", "dimwit"])
        text = " ".join(words) + (" " + passage if i % 7 == 0 else "")
        rows.append((i, text, "en", rng.choice(["a", "a", "b", None]), len(text), int(i % 5 == 0)))
    rows += [(160 + k, rows[k][1], "en", "b", rows[k][4], rows[k][5]) for k in range(0, 40, 3)]
    return rows + [(300, None, None, "b", None, 0), (301, "", "en", "c", 0, 0)]


def without_repeats(texts, window):
    """texts less what plain() of the substring test takes away."""
    docs = [t.encode() for t in texts]
    seen = Counter(d[i : i + window] for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode(errors="ignore"))
    return out


def test_each_stage_against_a_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    model = toxicity.fit(toxicity.sample(docs, table(spark, str(tmp_path), "labels")))
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    seen = {r.doc_id: r for r in docs.collect()}

    docs = written(stages["toxicity"](spark, docs, str(tmp_path)), "t")
    want = {i for i, r in seen.items() if model.scores([r.text or ""])[0] < 0.5}
    seen = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and seen.keys() == want and not want & {r[0] for r in rows if r[5] == 1}

    docs = written(stages["simhash_near_dedup"](spark, docs, str(tmp_path)), "s")
    groups = plain_components({i: plain_fingerprint(r.text) for i, r in seen.items()})
    seen = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and seen.keys() == {i for i, g in groups.items() if i == g}

    docs = written(stages["suffix_array_dedup"](spark, docs, str(tmp_path)), "p")
    ids = sorted(seen)
    left = dict(zip(ids, without_repeats([seen[i].text or "" for i in ids], corpus_pipeline.REPEAT_BYTES), strict=True))
    seen = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and {i: r.text for i, r in seen.items()} == left and all(r.n_chars == len(r.text) for r in seen.values())

    docs = written(stages["source_mixing"](spark, docs, str(tmp_path)), "m")
    times, size, taken = Counter(r.doc_id for r in docs.collect()), defaultdict(int), defaultdict(int)
    for i, r in seen.items():
        size[r.source] += len(r.text.split())
        taken[r.source] += times[i] * len(r.text.split())
    goal = plain_targets(size)
    assert docs.columns == columns and max(times.values()) <= 3
    assert all(abs(taken[s] - goal[s]) <= max(len(r.text.split()) for r in seen.values()) / 2 + 1e-6 for s in size)

    out = stages["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    check_packing(out, 4096)
    assert Counter(r.doc_id for r in out) == times
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert all(r.length == len(np.frombuffer(enc.encode(seen[r.doc_id].text), "<u4")) + 1 for r in out)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.length, r.ids_crc32) for r in out)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and __spark_entry__.oracle_sql().keys() <= names.keys()
