"""op1 keeps near copies apart."""

import pandas as pd
import plain

from leadflow.llm.queries import op1_best_fit_packing


def test_op1_puts_no_near_copies_into_one_bin(spark, tmp_path):
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(60)]
        rows += [" ".join([*words[:-1], f"end{k}"]) for k in range(5)] + [f"alone {g} " + " ".join(f"x{g}y{i}" for i in range(20))]
    frame = pd.DataFrame({"doc_id": [*range(len(rows)), None, None], "text": [*rows, "same text", "Same text"], "source": [f"s{i % 7}" for i in range(len(rows) + 2)], "lang": "en"}).astype({"doc_id": "Int64"})
    frame.to_parquet(tmp_path / "documents.parquet")
    got = op1_best_fit_packing(spark, str(tmp_path)).toPandas()
    component = plain.components(dict(enumerate(rows)))
    assert len(set(component.values())) == 12
    assert len(got) == len(frame) and got["n_words"].sum() == sum(len(t.split()) for t in frame["text"])
    for _, g in got.groupby("bin"):
        inside = [component[int(i)] for i in g["doc_id"].dropna()]
        assert len(set(inside)) == len(inside)
        assert g["doc_id"].isna().sum() <= 1
