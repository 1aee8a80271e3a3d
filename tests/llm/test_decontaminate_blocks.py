"""One block or many: rows with null or shared ids keep their own hits, and texts are judged as they came."""

from wardloom.llm import decontaminate

WORDS = [f"w{i}" for i in range(60)]
ITEMS = [(1, " ".join(WORDS[:15])), (2, " ".join(WORDS[10:30])), (3, " ".join(WORDS[40:52]))]


def test_blocks_agree(spark):
    texts = [" ".join(WORDS), "a  b " + ", ".join(WORDS[:35]), "  --  ".join(WORDS[5:30]), "nothing here", None, "", " ".join(WORDS[38:55])]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts] + [(20 + i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    key = lambda f: sorted(map(str, f.collect()))
    one = key(decontaminate.scan(frame, benchmark))
    assert sum("n_hit=0" not in x for x in one) == 12
    assert key(decontaminate.scan(frame, benchmark, block_bytes=10)) == one
    assert key(decontaminate.remove(frame, benchmark, how="spans", block_bytes=10)) == key(decontaminate.remove(frame, benchmark, how="spans"))
    assert key(decontaminate.remove(frame, benchmark, block_bytes=10)) == key(decontaminate.remove(frame, benchmark))
