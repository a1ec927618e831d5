from fathom.llm.chat_format import format_chats

SCHEMA = "conv_id long, turn long, role string, text string, n string"


def rendered(spark, rows, **how):
    got = format_chats(spark.createDataFrame(rows, SCHEMA), **how).collect()
    out = {}
    for r in sorted(got, key=lambda r: r.part):
        out[r.conv_id] = (r.n_turns, out.get(r.conv_id, (0, ""))[1] + r.text)
    return out


def turns(conv, texts):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t, None) for i, t in enumerate(texts)]


def test_snapshots_go_and_the_least_of_equals_stays(spark):
    rows = (turns(1, ["a"]) + turns(2, ["a", "b"]) + turns(3, ["a", "b", "c"]) + turns(4, ["a", "b", "c"])
            + turns(5, ["a", "x"]) + turns(6, ["b"]) + turns(7, ["b", "c", "d", "e"]) + turns(8, ["c"]))
    assert sorted(rendered(spark, rows)) == [3, 5, 7, 8]


def test_rendering_order_nulls_and_markers(spark):
    rows = [(1, 2, "user", "late", None), (1, None, None, None, None), (1, 1, "user", "<|im_end|>x", None),
            (1, 1, "user", "<|im_end|>x", None), (None, 0, "user", "lost", None), (2, 0, "user", "", None)]
    got = rendered(spark, rows)
    assert got[1] == (3, "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n<im_end>x<|im_end|>\n<|im_start|>user\nlate<|im_end|>\n")
    assert got[2] == (1, "<|im_start|>user\n<|im_end|>\n") and set(got) == {1, 2}


def test_blocks_do_not_change_the_result(spark):
    """Gaps in the turn numbers and blocks of two turns: the same prefixes, in parts."""
    long = [f"t{i}" for i in range(23)]
    spread = [(2, 10 * i, r[2], r[3], None) for i, r in enumerate(turns(2, long))]
    rows = turns(1, long[:11]) + spread + turns(3, long[:10] + ["other"])
    assert rendered(spark, rows, block_turns=2) == rendered(spark, rows)
    assert sorted(rendered(spark, rows, block_turns=2)) == [2, 3]
    parts = format_chats(spark.createDataFrame(rows, SCHEMA), block_turns=2).filter("conv_id = 2").count()
    assert parts == 12


def test_many_copies_and_empty_table(spark):
    rows = [r for c in range(200) for r in turns(c, ["same", "talk"])] + turns(900, ["same", "talk", "goes on"])
    assert sorted(rendered(spark, rows)) == [900]
    assert rendered(spark, []) == {}


def test_very_long_conversations_do_not_overflow(spark):
    from pyspark.sql import functions as F

    from fathom.llm.chat_format import maximal_conversations, turn_prefixes
    n = (1 << 21) + 3
    turns = spark.range(n).select(F.lit(1).alias("c"), F.col("id").alias("t"), F.lit("user").alias("r"), F.concat(F.lit("m"), F.col("id") % 7).alias("x"))
    snap = turns.filter(F.col("t") < n - 5).withColumn("c", F.lit(2))
    p = turn_prefixes(turns.unionByName(snap), "c", "t", "r", "x", 512)
    assert [(r["__conv"], r["__n"]) for r in maximal_conversations(p).collect()] == [(1, n)]
