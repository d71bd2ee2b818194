"""Word-substitution robustness tests and augmentation.

The reference tries synonyms one prompt at a time and stops at the first
flip. Here every candidate of every prompt is built at once (at most
``top_k * max_synonyms`` per prompt), re-scored in one bulk job, and the
first flip per position is the flip with the lowest synonym rank: the same
answer without a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptscreen.constants import MAX_SYNONYMS, STOP_WORDS, THRESHOLD, TOKEN_PATTERN, TOP_K_TOKENS
from promptscreen.functions.scalar import content_id, decide
from promptscreen.functions.text import lemma_name, rebuild_text, replace_first, tokens
from promptscreen.operators import delta, explain
from promptscreen.operators.joins import bounded_broadcast
from promptscreen.operators import tfidf as T
from promptscreen.session import ensure_checkpoint_dir

AUGMENTED_TYPE = "adversarial_augmented"
# A lexicon up to this many (word, synonym) rows is broadcast (a thesaurus has
# ~10^5); a larger one is shuffle-joined and AQE splits hot words.
LEXICON_BROADCAST_ROWS = 2_000_000


def lexicon_side(synonyms: DataFrame, max_rows: int = LEXICON_BROADCAST_ROWS) -> DataFrame:
    """Broadcast the prepared lexicon only after checking its row count."""
    return bounded_broadcast(synonyms, max_rows)


def prepare_synonyms(lexicon: DataFrame, max_synonyms: int = MAX_SYNONYMS) -> DataFrame:
    """``(word, synonym, syn_rank)``: normalised, without the word itself,
    de-duplicated (best rank kept), at most ``max_synonyms`` per word (U5, F7)."""
    s = lexicon.select(F.lower("word").alias("word"), lemma_name("synonym").alias("synonym"),
                       "rank")
    s = s.filter(F.col("synonym") != F.col("word")).groupBy("word", "synonym").agg(
        F.min("rank").alias("rank"))
    w = Window.partitionBy("word").orderBy("rank", "synonym")
    return (s.withColumn("syn_rank", F.row_number().over(w))
            .filter(F.col("syn_rank") <= max_synonyms).drop("rank"))


def synonym_candidates(top: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Each chosen token position with each of its synonyms."""
    return top.join(lexicon_side(synonyms.withColumnRenamed("word", "token")), "token")


def synonym_flips(scorer, rows: DataFrame, lexicon: DataFrame, top_k: int = TOP_K_TOKENS,
                  max_synonyms: int = MAX_SYNONYMS, threshold: float = THRESHOLD,
                  require_correct: bool = False, id_col: str = "prompt_id") -> DataFrame:
    """Importance-guided synonym substitution.

    ``rows`` (id, prompt, label, data_type) is the source table; the
    workflow's default attacks ``adversarial_benign`` test prompts, which
    leaks test prompts into training if the result is used for
    augmentation -- prefer the validation split. ``require_correct`` skips
    prompts the model already gets wrong (the attack library's behaviour).
    """
    # Term-heavy steps read one (id, text) exchange; labels join back by id.
    base = T.by_id(rows.select(id_col, "prompt"), id_col)
    meta = rows.select(id_col, "label", "data_type")
    fast = delta.supports(scorer)
    if fast:
        known, stats = delta.prepared(scorer, base, id_col=id_col)
        orig = delta.original_scores(scorer, meta, stats, id_col)
    else:
        orig = stored(scorer.score(base, id_col=id_col, partitioned=True).drop("prompt").join(meta, id_col))
    orig = orig.select(id_col, "label", "data_type", decide("prob_harmful", threshold).alias(
        "original_predicted_label"))
    if require_correct:
        orig = orig.filter(F.col("original_predicted_label") == F.col("label"))
    top = explain.top_positions(explain.position_scores(scorer, base, id_col=id_col,
                                                        partitioned=True), top_k, id_col)
    synonyms = prepare_synonyms(lexicon, max_synonyms)
    lp = F.lower("prompt")
    keys = ["token_rank", "syn_rank"]
    if fast:
        # what the first occurrence stands in decides the changed terms; the text goes no further
        near = surroundings(top.join(base, id_col), scorer.spec)
        cand = synonym_candidates(near, synonyms).filter(F.col("synonym") != F.col("token"))
        new_words = delta.words(F.concat("_left", "synonym", "_right"), scorer.spec)
        old_words = delta.words(F.concat("_left", "token", "_right"), scorer.spec)
        cand = cand.withColumn("edit", delta.edit(F.col("_prev"), old_words, new_words, F.col("_next"), scorer.spec))
        cand = stored(cand.select(id_col, *keys, "pos", "token", "synonym", "edit"))    # read three times
        new = delta.variant_scores(scorer, cand.select(id_col, *keys, "edit"), known, stats, keys, id_col)
    else:
        picked = stored(synonym_candidates(top, synonyms).select(id_col, *keys, "pos", "token", "synonym"))
        cand = picked.join(base, id_col)
        text = replace_first(lp, F.col("token"), F.col("synonym"))
        cand = (cand.withColumn("_text", text).filter(F.col("_text").isNotNull() & (F.col("_text") != lp))
                .withColumn("_cid", F.concat_ws(":", F.col(id_col).cast("string"), *keys)))
        scored = scorer.score(cand.select("_cid", "_text"), text_col="_text", id_col="_cid")
        new = scored.select("_cid", "prob_harmful").join(cand.select("_cid", id_col, *keys), "_cid")
    new = new.select(id_col, *keys, decide("prob_harmful", threshold).alias("new_predicted_label"))
    flips = cand.select(id_col, *keys, "pos", "token", "synonym").join(new, [id_col, *keys]).join(orig, id_col)
    flips = flips.filter(F.col("new_predicted_label") != F.col("original_predicted_label"))
    first = flips.groupBy(id_col, "token_rank").agg(F.min_by(F.struct(
        "pos", "token", "synonym", "original_predicted_label", "new_predicted_label", "label",
        "data_type"), F.col("syn_rank")).alias("f")).join(base, id_col)
    return first.select(
        id_col, "token_rank", "f.pos", F.col("prompt").alias("original_prompt"),
        replace_first(lp, F.col("f.token"), F.col("f.synonym")).alias("perturbed_prompt"),
        F.col("f.token").alias("original_token"),
        F.col("f.synonym").alias("replacement_token"), "f.original_predicted_label",
        "f.new_predicted_label", "f.label", F.lit(AUGMENTED_TYPE).alias("data_type"),
        F.col("f.data_type").alias("source_data_type"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder: scored once, read by several branches."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def surroundings(top: DataFrame, spec: T.TfidfSpec) -> DataFrame:
    """``top`` (token, prompt) without its text, but with what the first
    occurrence of the token, as a substring, stands in: the rest of its run of
    word characters (``_left``, ``_right``) and the feature words around that run
    (``_prev``, ``_next``)."""
    chars = TOKEN_PATTERN.rsplit("{", 1)[0]
    lp, at = F.lower("prompt"), F.instr(F.lower("prompt"), F.col("token"))
    top = (top.withColumn("_a", F.substr(lp, F.lit(1), at - 1))
           .withColumn("_b", F.substr(lp, at + F.length("token")))
           .withColumn("_left", F.regexp_extract("_a", f"{chars}*$", 0))
           .withColumn("_right", F.regexp_extract("_b", f"^{chars}*", 0)))
    before = F.substr("_a", F.lit(1), F.length("_a") - F.length("_left"))
    after = F.substr("_b", F.length("_right") + 1)
    return (top.withColumn("_prev", F.try_element_at(delta.words(before, spec), F.lit(-1)))
            .withColumn("_next", F.get(delta.words(after, spec), F.lit(0))).drop("_a", "_b", "prompt"))


def success_rates(attacks: DataFrame, targets: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """Share of target prompts with at least one flip (A8, substitution definition)."""
    n_flip = attacks.agg(F.count_distinct(id_col)).scalar()
    return targets.agg(F.count("*").alias("targets")).select(
        "targets", n_flip.alias("prompts_with_flip"),
        F.when(F.col("targets") == 0, F.lit(0.0)).otherwise(n_flip / F.col("targets"))
        .alias("success_rate"))


def as_training_rows(attacks: DataFrame, prompt_col: str = "perturbed_prompt",
                     data_type: str | None = None) -> DataFrame:
    """Attack results as train rows: perturbed text, the true label."""
    dt = F.lit(data_type) if data_type else F.col("data_type")
    rows = attacks.select(F.col(prompt_col).alias("prompt"), dt.alias("data_type"), "label",
                          F.col("prompt_id").alias("_src"), F.col("token_rank").alias("_tr"))
    return rows.withColumn("prompt_id", content_id("prompt", "data_type", "label", "_src", "_tr")
                           ).select("prompt_id", "prompt", "data_type", "label")


def augment(train: DataFrame, *attack_rows: DataFrame) -> DataFrame:
    """Train rows plus any number of attack-derived rows, by column name."""
    out = train.select("prompt_id", "prompt", "data_type", "label")
    for a in attack_rows:
        out = out.unionByName(a.select("prompt_id", "prompt", "data_type", "label"))
    return out


UNK = "[UNK]"
RF_AUGMENTED_TYPE = "adversarial_benign_augmented"


def _pieces() -> dict:
    return {"_toks": tokens("prompt"), "_seps": F.split(F.lower("prompt"), TOKEN_PATTERN, -1)}


@dataclass
class _Ranked:
    """Prompts to attack, those already wrong, the positions ``(id, pos, order, _b,
    ...)`` in the order of attack, and, for a linear scorer, its documents' terms and sums."""
    live: DataFrame
    skipped: DataFrame
    positions: DataFrame
    known: DataFrame | None
    stats: DataFrame | None


def _ranked(scorer, rows: DataFrame, lexicon: DataFrame, stop_words, max_synonyms: int, threshold: float,
            id_col: str) -> _Ranked:
    stop = list(STOP_WORDS if stop_words is None else stop_words)
    base = T.by_id(rows.select(id_col, "prompt", "label", "data_type"), id_col)
    fast, known, stats = delta.supports(scorer), None, None
    if fast:
        known, stats = delta.prepared(scorer, base, id_col=id_col)
        orig = delta.original_scores(scorer, base, stats, id_col)
    else:
        orig = stored(scorer.score(base, id_col=id_col, partitioned=True))
    y = F.col("label")

    def p_true(p):
        return F.when(y == 1, p).otherwise(F.lit(1.0) - p)

    orig = (orig.withColumn("original_output", decide("prob_harmful", threshold))
            .withColumn("_p0", p_true(F.col("prob_harmful")))
            .drop("logit", "prob_harmful"))
    skipped = orig.filter(F.col("original_output") != y)
    live = orig.filter(F.col("original_output") == y)
    pieces = _pieces()

    syn = prepare_synonyms(lexicon, max_synonyms).filter(~F.col("word").isin(*stop))
    lex = lexicon_side(syn.withColumnRenamed("word", "token"))
    if fast:
        pos = delta.token_rows(live, scorer.spec, id_col=id_col)
    else:
        pos = live.select(id_col, F.posexplode(tokens("prompt")).alias("pos", "token"))
    cand = pos.join(lex, "token")
    # variants: the word removed ([UNK]) and each synonym in its place
    unk = cand.drop("synonym", "syn_rank").distinct().withColumn("synonym", F.lit(UNK)).withColumn("syn_rank", F.lit(0))
    var = unk.unionByName(cand)
    keys = ["pos", "syn_rank"]
    if fast:
        old_words = F.filter(F.array(F.when(F.col("kept"), F.col("token"))), lambda w: w.isNotNull())
        var = var.withColumn("edit", delta.edit(F.col("prev"), old_words, delta.words("synonym", scorer.spec),
                                                F.col("next"), scorer.spec))
        vs = delta.variant_scores(scorer, var.select(id_col, *keys, "edit"), known, stats, keys, id_col)
    else:
        full = var.join(live.select(id_col, "prompt"), id_col).withColumns(pieces)
        new_toks = F.transform("_toks", lambda t, i: F.when(i == F.col("pos"), F.col("synonym")).otherwise(t))
        full = full.withColumn("_vid", F.concat_ws(":", F.col(id_col).cast("string"), *keys)).withColumn(
            "_text", rebuild_text(F.col("_seps"), new_toks))
        vs = scorer.score(full.select("_vid", "_text"), text_col="_text", id_col="_vid").select(
            "_vid", "prob_harmful").join(full.select("_vid", id_col, *keys), "_vid")
    var = stored(var.select(id_col, *keys, "synonym").join(vs.select(id_col, *keys, "prob_harmful"), [id_col, *keys])
                 .join(live.select(id_col, "label", "_p0"), id_col)
                 .select(id_col, *keys, "synonym", (F.col("_p0") - p_true(F.col("prob_harmful"))).alias("_drop")))
    sal = var.filter(F.col("syn_rank") == 0).select(id_col, "pos", F.col("_drop").alias("_sal"))
    best = var.filter(F.col("syn_rank") > 0).groupBy(id_col, "pos").agg(
        F.max_by(F.struct("synonym", "syn_rank"),
                 F.struct(F.col("_drop"), -F.col("syn_rank"))).alias("_b"),
        F.max("_drop").alias("_dp"))
    w_doc = Window.partitionBy(id_col)
    pr = sal.join(best, [id_col, "pos"]).withColumn(
        "_h", F.exp("_sal") / F.sum(F.exp("_sal")).over(w_doc) * F.col("_dp"))
    pr = pr.withColumn("order", F.row_number().over(
        w_doc.orderBy(F.col("_h").desc(), F.col("pos").asc())))
    return _Ranked(live, skipped, pr, known, stats)


def _attack_log(live: DataFrame, res: DataFrame, skipped: DataFrame, id_col: str) -> DataFrame:
    attacked = live.join(res, id_col, "left").select(
        id_col,
        F.when(F.col("_ok") == 1, F.lit("Successful")).otherwise(F.lit("Failed"))
        .alias("result_type"),
        F.col("prompt").alias("original_text"),
        F.coalesce("_text", F.lower("prompt")).alias("perturbed_text"),
        F.col("label").alias("ground_truth_output"), "original_output",
        F.coalesce("perturbed_output", "original_output").alias("perturbed_output"),
        F.coalesce("k", F.lit(0)).alias("num_changes"), "data_type")
    skip = skipped.select(
        id_col, F.lit("Skipped").alias("result_type"), F.col("prompt").alias("original_text"),
        F.lower("prompt").alias("perturbed_text"), F.col("label").alias("ground_truth_output"),
        "original_output", F.col("original_output").alias("perturbed_output"),
        F.lit(0).alias("num_changes"), "data_type")
    return attacked.unionByName(skip)


def greedy_substitution(scorer, rows: DataFrame, lexicon: DataFrame,
                        stop_words=None, max_synonyms: int = MAX_SYNONYMS,
                        threshold: float = THRESHOLD, id_col: str = "prompt_id") -> DataFrame:
    """Saliency-ordered greedy word substitution (M12; the published PWWS scheme).

    For every word position that has synonyms (stop words are never changed):
    saliency ``S_i`` = drop of P(true class) when the word becomes ``[UNK]``;
    best synonym = the largest drop ``dP_i`` (ties: lower rank); priority
    ``H_i = softmax(S)_i * dP_i``. Substitutions are applied cumulatively in
    priority order (ties: earlier position); the first prefix that changes
    the prediction is the result. All variants and all prefixes are scored in
    bulk jobs. Synonyms are chosen once, on the original text;
    :func:`stepwise.stepwise_substitution` chooses each on the current text. Prompts the model already gets wrong are
    ``Skipped``; no flip gives ``Failed``.

    Text is handled lower-cased; word positions are the tokens of the
    featurizer, and separator pieces keep the rest of the text intact. A linear
    scorer takes variants and prefixes from their changed terms (:mod:`delta`):
    one text is built per prompt, the result's. Any other scorer gets the text
    of each variant and of each prefix.
    """
    r = _ranked(scorer, rows, lexicon, stop_words, max_synonyms, threshold, id_col)
    live, pr, y = r.live, r.positions, F.col("label")
    pieces = _pieces()
    plan = pr.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.struct("order", "_b.synonym"))))
        .alias("_plan"), F.count("*").alias("_c"))
    # per token: its order in the plan (or none) and its replacement
    doc = live.join(plan, id_col).withColumns(pieces).withColumn("_ord", F.transform("_toks", lambda t, i: F.element_at("_plan", i)))
    text = rebuild_text(F.col("_seps"), F.transform(
        F.arrays_zip(F.col("_toks").alias("t"), F.col("_ord").alias("o")),
        lambda z: F.when(z["o"].isNotNull() & (z["o"]["order"] <= F.col("k")), z["o"]["synonym"]).otherwise(z["t"])))
    if r.known is not None:
        ps = delta.step_scores(scorer, _steps(doc, scorer.spec, id_col), r.known, r.stats, "k", id_col)
    else:
        pref = doc.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_c")))).select(
            id_col, "k", text.alias("_text"), F.concat_ws(":", F.col(id_col).cast("string"), "k").alias("_kid"))
        ps = scorer.score(pref.select("_kid", "_text"), text_col="_text", id_col="_kid").select(
            "_kid", "prob_harmful").join(pref.select("_kid", id_col, "k"), "_kid")
    ps = ps.select(id_col, "k", decide("prob_harmful", threshold).alias("perturbed_output")).join(
        live.select(id_col, "label"), id_col)
    flips = F.col("perturbed_output") != y
    res = ps.groupBy(id_col).agg(
        # the first flipping prefix; without a flip, the full one
        F.min_by(F.struct("k", "perturbed_output"), F.struct(~flips, F.when(flips, F.col("k")).otherwise(-F.col("k")))).alias("_r"),
        F.max(F.when(flips, 1).otherwise(0)).alias("_ok"))
    res = doc.join(res, id_col).withColumn("k", F.col("_r.k")).select(
        id_col, "k", text.alias("_text"), "_r.perturbed_output", "_ok")
    return _attack_log(live, res, r.skipped, id_col)


# Tokens looked at on either side for a neighbour that is not empty; all are if these are.
NEAR_TOKENS = 8


def _steps(doc: DataFrame, spec: T.TfidfSpec, id_col: str) -> DataFrame:
    """``(id, k, edit)``: the changed terms of the ``k``-th substitution of a
    plan, between the words that stand around it after the earlier ones."""
    kept = F.transform("_toks", lambda t, i: F.struct(
        F.filter(F.array(t), lambda w: ~w.isin(*spec.stop_words)).alias("base"),
        F.get("_ord", i)["order"].alias("order"), delta.words(F.get("_ord", i)["synonym"], spec).alias("rep")))
    rows = doc.select(id_col, F.filter(kept, lambda x: (F.size(x["base"]) > 0) | x["order"].isNotNull()).alias("_a"))
    n = F.lit(NEAR_TOKENS)
    changed = F.filter(F.transform("_a", lambda x, j: F.when(x["order"].isNotNull(), j)), lambda j: j.isNotNull())
    # a row holds what stands near its token, never the whole text
    near = rows.select(id_col, F.explode(F.transform(changed, lambda j: F.struct(
        j.alias("j"), F.get("_a", j).alias("x"), (F.size("_a") - 1 - j).alias("behind"),
        F.slice("_a", F.greatest(j - n, F.lit(0)) + 1, F.least(j, n)).alias("left"),
        F.slice("_a", j + 2, n).alias("right")))).alias("_e")).select(id_col, "_e.*")

    def now(part):
        return F.flatten(F.transform(part, lambda x: F.when(
            F.coalesce(x["order"] < F.col("x.order"), F.lit(False)), x["rep"]).otherwise(x["base"])))

    near = near.select(id_col, "j", "x", "behind", F.try_element_at(now(F.col("left")), F.lit(-1)).alias("prev"),
                       F.get(now(F.col("right")), F.lit(0)).alias("after"))
    # nothing but empty replacements near: the whole text is looked at
    short = ((F.col("prev").isNull() & (F.col("j") > NEAR_TOKENS))
             | (F.col("after").isNull() & (F.col("behind") > NEAR_TOKENS)))
    far = near.filter(short).join(rows, id_col).withColumns({
        "prev": F.coalesce("prev", F.try_element_at(now(F.slice("_a", F.lit(1), F.col("j"))), F.lit(-1))),
        "after": F.coalesce("after", F.get(now(F.slice("_a", F.col("j") + 2, F.size("_a"))), F.lit(0)))}).drop("_a")
    found = near.filter(~short).unionByName(far)
    return found.select(id_col, F.col("x.order").alias("k"),
                        delta.edit(F.col("prev"), F.col("x.base"), F.col("x.rep"), F.col("after"), spec).alias("edit"))


def greedy_success_rate(results: DataFrame) -> DataFrame:
    """Successful attacks / all attacked rows (A8, greedy definition)."""
    return results.agg(F.count("*").alias("attacked"),
                       F.count_if(F.col("result_type") == "Successful").alias("successful"),
                       F.count_if(F.col("result_type") == "Failed").alias("failed"),
                       F.count_if(F.col("result_type") == "Skipped").alias("skipped")).withColumn(
        "success_rate", F.when(F.col("attacked") == 0, F.lit(0.0))
        .otherwise(F.col("successful") / F.col("attacked")))


def greedy_training_rows(results: DataFrame) -> DataFrame:
    """Successful greedy attacks as train rows of type ``adversarial_benign_augmented``."""
    ok = results.filter(F.col("result_type") == "Successful")
    rows = ok.select(F.col("perturbed_text").alias("prompt"),
                     F.lit(RF_AUGMENTED_TYPE).alias("data_type"),
                     F.col("ground_truth_output").alias("label"), F.col("prompt_id").alias("_src"))
    return rows.withColumn("prompt_id", content_id("prompt", "data_type", "label", "_src")).select(
        "prompt_id", "prompt", "data_type", "label")
