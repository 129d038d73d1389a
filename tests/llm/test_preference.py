import duckdb
from pyspark.sql import functions as F

from cauza.llm import preference as P

ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"),
    (2, 0, "user", "same"), (3, 5, "user", "same"), (4, 0, "user", "alone"), (7, 1, "assistant", "right only"), (8, None, None, None), (8, 0, "user", "<|assistant|> é"), (9, 0, "user", ""), (9, 0, "user", ""), (9, 0, "assistant", "tie"),
    (None, 0, "user", "lost"), (10, 0, "user", "x" * 100_000), (11, 0, "user", "x" * 100_000), (11, 1, "assistant", "y"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, pair_id int, prompt string")


def neighbours(turns):
    """Conversations 2k (chosen) and 2k + 1 as they are."""
    return P.format_pairs(turns, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 0)


def test_branches_match_sql(spark):
    df = P.branches(frame(spark, ROWS))
    c = duckdb.connect()
    conversations = frame(spark, ROWS).toPandas()  # noqa: F841
    c.execute("CREATE VIEW v AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations")
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({P.SQL.replace('FROM conversations', 'FROM v')})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_prefix_and_masks(spark):
    out = {r.pair_id: r for r in neighbours(frame(spark, ROWS)).collect()}
    r = out[0]
    assert r.n_common == 3 and r.prompt.endswith("<|user|>\nmore<|end|>\n") and r.chosen_completion == "<|assistant|>\ngood<|end|>\n"
    for text, mask in ((r.chosen_completion, r.chosen_mask), (out[4].chosen_completion, out[4].chosen_mask), (out[5].rejected_completion, out[5].rejected_mask)):
        at, learned = 0, ""
        for run in mask.split(","):
            n, flag = map(int, run.split(":"))
            learned += text[at : at + n] if flag else ""
            at += n
        assert at == len(text)
        assert all(part.endswith("<|end|>") for part in [learned] if learned)
    assert r.chosen_mask == "14:0,11:1,1:0"
    assert out[1].chosen_completion == out[1].rejected_completion == "" and out[1].n_common == 1
    assert out[2].rejected_id is None and out[2].n_common == 0 and out[3].chosen_id is None
    assert "< |assistant|>" in out[4].chosen_completion and None not in out
    assert neighbours(frame(spark, ROWS).limit(0)).collect() == []


def test_branches_share_a_prompt(spark):
    out = {r.pair_id: r for r in P.branches(frame(spark, ROWS)).collect()}
    assert out[0].n_common == 3 and out[0].n_rejected == 4  # half by rule, one more as both go on alike
    assert out[0].rejected_completion == "<|assistant|>\nbad<|end|>\n"
    assert (out[0].chosen_id, out[0].rejected_id, out[2].rejected_id, out[3].chosen_id) == (0, 1, None, None)
    assert P.branches(frame(spark, ROWS).limit(0)).collect() == []


def test_table_exercises_the_common_prefix(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = P.branches(turns).collect()
    own = {}
    for r in turns.collect():
        own.setdefault(r.conv_id, set()).add((r.turn, r.role, r.text))
    shared = [r for r in out if r.n_common > 0]
    assert len(shared) >= 0.9 * len(out) > 0
    for r in shared:
        turns_of = sorted(own[r.chosen_id])
        assert r.n_common >= len(turns_of) // 2
        assert r.prompt.count("<|end|>\n") == r.n_common and r.prompt + r.chosen_completion == "".join(f"<|{role}|>\n{text.replace('<|', '< |')}<|end|>\n" for _, role, text in turns_of)
