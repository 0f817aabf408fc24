from rankspark.llm import leak


def test_short_windows_after_a_segment_count_once(spark):
    text = "word " * leak.SEGMENT + "alpha beta gamma" + " word" * 40
    items = [(1, "alpha beta gamma"), (2, " ".join(f"x{i}" for i in range(12)))]
    found = leak.leaked_items(spark.createDataFrame([(5, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.key, r.item, r.windows, r.copied) for r in found] == [(5, 1, 1, True)]
