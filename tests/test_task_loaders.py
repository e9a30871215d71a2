"""The five task loaders on small fixture files."""

import csv
import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidecorpus import constants as K
from tidecorpus.operators import task_loaders as tl


def _csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def _counts(df):
    return {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}


def test_sentiment_presplit_and_unknown(spark):
    d = tempfile.mkdtemp(prefix="tc-sent-", dir="/tmp")
    rows = [(f"texto {i} @alguien\nlinea", "es", K.SENTIMENT_POLARITY[i % 3], ["train", "dev", "test"][i % 3]) for i in range(30)]
    _csv(os.path.join(d, "sentiment.csv"), ["text", "lang", "polarity", "split"], rows)
    df = tl.load_sentiment(spark, os.path.join(d, "sentiment.csv"))
    assert _counts(df) == {"train": 10, "dev": 10, "test": 10}
    r = df.filter(F.col("split") == "dev").first()
    assert r["label"] == 1 and "@usuario" in r["text"] and "\n" not in r["text"]
    assert _counts(tl.load_sentiment(spark, os.path.join(d, "sentiment.csv"), limit=4)) == {"train": 4, "dev": 4, "test": 4}
    _csv(os.path.join(d, "bad.csv"), ["text", "lang", "polarity", "split"], [("x", "es", "MAYBE", "train")])
    with pytest.raises(Exception):
        tl.load_sentiment(spark, os.path.join(d, "bad.csv")).collect()


def test_emotion_stratified_dev(spark):
    d = tempfile.mkdtemp(prefix="tc-emo-", dir="/tmp")
    train = [(f"t{i}", K.EMOTION_LABELS[i % 7]) for i in range(70)]
    _csv(os.path.join(d, "train.csv"), ["id", "text", "label"], [(i, t, lab) for i, (t, lab) in enumerate(train)])
    _csv(os.path.join(d, "test.csv"), ["id", "text", "label"], [(i, f"x{i}", "joy") for i in range(5)])
    df = tl.load_emotion(spark, os.path.join(d, "train.csv"), os.path.join(d, "test.csv"), preprocess=False)
    c = _counts(df)
    assert c["dev"] == math.ceil(0.25 * 70) and c["train"] + c["dev"] == 70 and c["test"] == 5
    assert {r["label"] for r in df.collect()} == set(range(7))


def test_hate_and_irony(spark):
    d = tempfile.mkdtemp(prefix="tc-hate-", dir="/tmp")
    for s, n in (("train", 6), ("dev", 3), ("test", 4)):
        _csv(os.path.join(d, f"{s}.csv"), ["id", "text", "HS", "TR", "AG"], [(i, f"{s} {i}", i % 2, 0, 0) for i in range(n)])
    h = tl.load_hate(spark, *(os.path.join(d, f"{s}.csv") for s in ("train", "dev", "test")))
    assert _counts(h) == {"train": 6, "dev": 3, "test": 4} and h.columns == ["text", "label", "split"]
    rows = [(i, "t", i % 2, f"ironia {i}", "es", "train" if i < 40 else "test") for i in range(50)]
    _csv(os.path.join(d, "irony.csv"), ["id", "topic", "is_ironic", "text", "lang", "split"], rows)
    ir = tl.load_irony(spark, os.path.join(d, "irony.csv"))
    assert _counts(ir) == {"train": 30, "dev": 10, "test": 10}


def test_context_hate(spark):
    d = tempfile.mkdtemp(prefix="tc-ctx-", dir="/tmp")

    def art(k, n):
        return {"title": f"Nota #Titulo{k}", "comments": [dict({"id": k * 100 + j, "text": f"comentario {j}", "HATEFUL": j % 2}, **{c: int(c == "CALLS" and j % 3 == 0) for c in K.EXTENDED_HATE_CATEGORIES}) for j in range(n)]}

    with open(os.path.join(d, "train.json"), "w") as f:
        json.dump([art(k, 5) for k in range(4)] + [{"title": "vacío", "comments": []}], f)
    with open(os.path.join(d, "test.json"), "w") as f:
        json.dump([art(9, 3)], f)
    df = tl.load_context_hate(spark, os.path.join(d, "train.json"), os.path.join(d, "test.json"))
    assert _counts(df) == {"train": 16, "dev": 4, "test": 3}
    r = df.filter(F.col("split") == "test").orderBy("id").first()
    assert r["title"] == "Nota hashtag Titulo9" and len(r["labels"]) == 9 and r["labels"][0] == 1


def test_splits_do_not_follow_the_scan(spark):
    """One file or several, small blocks or one: the same rows fall into dev, and the first rows are the same."""
    d = tempfile.mkdtemp(prefix="tc-stable-", dir="/tmp")
    rows = [(i, f"texto {i}\n" + "y" * (i % 90), K.EMOTION_LABELS[i % 7]) for i in range(140)]
    _csv(os.path.join(d, "test.csv"), ["id", "text", "label"], rows[:3])
    os.makedirs(os.path.join(d, "one")), os.makedirs(os.path.join(d, "many"))
    _csv(os.path.join(d, "one", "a.csv"), ["id", "text", "label"], rows)
    for k in range(4):  # of very different sizes, so that they are packed into tasks in another order
        _csv(os.path.join(d, "many", f"{k}.csv"), ["id", "text", "label"], rows[[0, 5, 100, 110][k] : [5, 100, 110, 140][k]])
    keys = {"spark.sql.files.maxPartitionBytes": "1200", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "20"}
    old = {k: spark.conf.get(k, None) for k in keys}
    got = []
    for conf in (keys, {}):
        for folder in ("one", "many"):
            for k in keys:
                spark.conf.set(k, conf[k]) if conf else (spark.conf.unset(k) if old[k] is None else spark.conf.set(k, old[k]))
            load = lambda **kw: tl.load_emotion(spark, os.path.join(d, folder), os.path.join(d, "test.csv"), preprocess=False, **kw)  # noqa: B023,E731
            got.append((sorted((r["text"], r["split"]) for r in load().collect()), sorted((r["text"], r["split"]) for r in load(limit=9).collect())))
    assert all(g == got[0] for g in got) and sum(s == "dev" for _, s in got[0][0]) == 35 and len(got[0][1]) == 9 + 9 + 3
