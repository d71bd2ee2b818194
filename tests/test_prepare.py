
from promptscreen.operators import prepare

RAW = "prompt_id bigint, data_type string, vanilla string, adversarial string"


def test_blank_prompts_dropped_and_fallback(spark):
    rows = [
        (1, "vanilla_benign", None, None),            # null prompt
        (2, "vanilla_benign", "", None),              # empty
        (3, "vanilla_benign", "   ", None),           # spaces
        (4, "vanilla_harmful", "\t\n", None),         # tab + newline
        (5, "adversarial_benign", "plain text", "  "),  # blank adversarial -> vanilla
        (6, "adversarial_harmful", "plain", "twisted"),  # adversarial text used
        (7, None, "no type", None),                    # null type -> label 0
        (8, "vanilla_benign", " x", None),             # kept
    ]
    out = prepare.prepare_prompts(spark.createDataFrame(rows, RAW))
    got = {r.prompt_id: (r.prompt, r.label) for r in out.collect()}
    assert set(got) == {5, 6, 7, 8}
    assert got[5] == ("plain text", 0)
    assert got[6] == ("twisted", 1)
    assert got[7] == ("no type", 0)
    assert got[8] == (" x", 0)


def test_union_by_name_with_missing_column(spark):
    a = spark.createDataFrame([(1, "vanilla_benign", "v", None)], RAW)
    b = spark.createDataFrame([(2, "adversarial_benign", "adv")],
                              "prompt_id bigint, data_type string, adversarial string")
    u = prepare.union_raw(a, b)
    assert set(u.columns) == {"prompt_id", "data_type", "vanilla", "adversarial"}
    r = {x.prompt_id: x for x in u.collect()}
    assert r[2].vanilla is None and r[2].adversarial == "adv"


def test_prompt_id_for_copies(spark):
    rows = [("same", "vanilla_benign", 0)] * 5 + [("other", "vanilla_benign", 0)]
    df = spark.createDataFrame(rows, "prompt string, data_type string, label int").repartition(3)
    out = prepare.assign_prompt_id(df).collect()
    assert len(out) == 6
    assert len({r.prompt_id for r in out}) == 6
    same = sorted(r.dup_no for r in out if r.prompt == "same")
    assert same == [1, 2, 3, 4, 5]
