"""Every query over rows with nulls, repeats, ties and long texts, without and with further columns of clashing names."""

import pytest
from tesela.llm.queries import QUERIES

pytest.importorskip("public_tokenizers")

CLASH = "id key hash text_hash n set_id comp class_id score learn place lines removed digest kept tokens items value".split()
PASSAGE = " ".join(f"leak{k}" for k in range(20))


def documents():
    words = "the quick brown fox jumps over a lazy dog while seven grey cats watch from the wall".split()
    texts = [" ".join(words[(i * k) % len(words)] + str(k % 3) for k in range(1, 30)) for i in range(1, 40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, " \n\t\n "), (None, None), (None, texts[3]), (103, texts[3]), (103, texts[3])]
    rows += [(104, texts[5] + " more"), (105, "x" * 60_000), (106, "one line\n" * 5_000), (107, "naïve 北京 \U0001f600 " + PASSAGE)]
    return rows


def tables(spark, folder, further):
    made = {
        "documents": (documents(), "doc_id long, text string"),
        "labels": ([(i, i % 2, i % 3 % 2) for i in range(39)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, "北京 lazy")], "item_id long, text string"),
        "pages": (
            [(1, "http://a.org/x", "<p>1"), (1, "http://a.org/x", "<p>1"), (2, None, "<p>2"), (3, "http://a.org/x#y", None)],
            "page_id long, url string, html string",
        ),
    }
    for name, (rows, schema) in made.items():
        for column in CLASH + ["text", "doc_id", "url"] if further else []:
            if f"{column} " not in schema:
                rows, schema = [(*r, "clash") for r in rows], f"{schema}, {column} string"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return [tables(spark, tmp_path_factory.mktemp("awkward"), further) for further in (False, True)]


@pytest.mark.parametrize("name", list(QUERIES))
def test_further_columns_change_nothing(spark, folders, name):
    plain, further = (QUERIES[name](spark, folder) for folder in folders)
    assert plain.columns == further.columns
    rows = [sorted((tuple(r) for r in found.collect()), key=str) for found in (plain, further)]
    if name == "op5_toxicity" or name == "op3_quality":
        # Sums of floats may differ in their last places.
        rows = [[(*r[:2], round(r[2], 6), r[3]) for r in found] for found in rows]
    if name == "op4_lm":
        rows = [[(*r[:5], round(r[5], 6), round(r[6], 6)) for r in found] for found in rows]
    assert rows[0] == rows[1]
    if name != "op10_warc_revisits":
        ids = [r[plain.columns.index("doc_id")] for r in rows[0]]
        assert sorted(ids, key=str) == sorted((d[0] for d in documents()), key=str)
