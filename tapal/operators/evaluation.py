"""Evaluation: spans and metrics, error matrix, percentiles, sampling, splits, leakage, and geographic features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators.ranking import cumulated, ranked


def spans(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(key, type, start, end): the spans of BIO labels, end exclusive; a stray I- opens none.

    A span starts at each B- and goes on over I- of its type; it is told within the row's own array.
    """
    e = (
        f"filter(transform(`{labels}`, (tag, i) -> if(tag like 'B-%', named_struct('type', substring(tag, 3), 'start', i, "
        f"'end', i + 1 + coalesce(nullif(array_position(transform(slice(`{labels}`, i + 2, size(`{labels}`)), x -> x <> concat('I-', substring(tag, 3))), true), 0) - 1, size(`{labels}`) - i - 1)), null)), s -> s is not null)"
    )
    return df.select(key, F.explode(F.expr(e)).alias("s")).select(key, "s.type", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def span_structs(labels: str, types: list[str]) -> Column:
    """The spans of a row's BIO labels of some types, as an array of (type, start, end)."""
    start = F.filter(F.transform(labels, lambda l, i: F.when(l.startswith("B-") & F.substring(l, 3, 99).isin(types), F.struct(F.substring(l, 3, 99).alias("type"), i.alias("start")))), lambda s: s.isNotNull())
    rest = lambda s: F.array_position(F.transform(F.slice(labels, s["start"] + 2, F.size(labels)), lambda l: l != F.concat(F.lit("I-"), s["type"])), True)
    return F.transform(start, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), F.when(rest(s) > 0, s["start"] + rest(s)).otherwise(F.size(labels)).cast("int").alias("end")))


def is_bio(labels: Column) -> Column:
    """Whether all labels are known and no I- stands without its type before it."""
    known = F.forall(labels, lambda l: l.isin(S.LABELS))
    return known & F.forall(F.transform(labels, lambda l, i: ~l.startswith("I-") | F.coalesce(F.substring(F.get(labels, i - 1), 3, 99) == F.substring(l, 3, 99), F.lit(False))), lambda x: x)


def repaired(labels: str) -> Column:
    """BIO labels with each stray I- made a B-. A repair never changes the type, so the raw neighbour decides."""
    return F.expr(f"transform(`{labels}`, (tag, i) -> if(tag like 'I-%' and (i = 0 or substring(`{labels}`[i - 1], 3) <> substring(tag, 3) or `{labels}`[i - 1] = 'O'), concat('B-', substring(tag, 3)), tag))")


def invalid_transitions(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(key, position, label): unknown labels and I- that nothing of its type comes before."""
    bad = F.filter(F.transform(labels, lambda l, i: F.struct(i.alias("position"), l.alias("label"), F.get(F.col(labels), i - 1).alias("before"))), lambda x: ~x["label"].isin(S.LABELS) | (x["label"].startswith("I-") & ~F.coalesce(F.substring(x["before"], 3, 99) == F.substring(x["label"], 3, 99), F.lit(False))))
    return df.select(key, F.explode(bad).alias("b")).select(key, F.col("b.position").cast("long").alias("position"), "b.label")


def _scores(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = S.ratio(tp, tp + fp), S.ratio(tp, tp + fn)
    f1 = F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def span_metrics(gold: DataFrame, predicted: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of exact spans, over all or by columns of the spans."""
    on = [key, "type", "start", "end"]
    both = gold.select(*on, F.lit(1).alias("g")).join(predicted.select(*on, F.lit(1).alias("p")), on, "full_outer")
    count = lambda c: F.count_if(c).alias
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    return _scores(both.groupBy(*(by or [])).agg(count(g & p)("tp"), count(~g & p)("fp"), count(g & ~p)("fn")))


def span_metrics_by_type(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """The same for each of the ten types, also those without spans."""
    found = span_metrics(gold, predicted, key, ["type"]).select("type", "tp", "fp", "fn")
    types = gold.sparkSession.createDataFrame([(t,) for t in S.FIELDS], "type string")
    return _scores(types.join(found, "type", "left").na.fill(0, ["tp", "fp", "fn"]))


def critical_exact_match(examples: DataFrame, gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(examples, exact, rate): examples whose spans of critical types are all the same."""
    on = [key, "type", "start", "end"]
    both = gold.select(*on, F.lit(1).alias("g")).join(predicted.select(*on, F.lit(1).alias("p")), on, "full_outer").where(F.col("type").isin(S.CRITICAL_FIELDS))
    wrong = both.where("g is null or p is null").select(key).distinct().withColumn("_w", F.lit(1))
    out = examples.select(key).join(wrong, key, "left").agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("_w").isNull()).alias("exact"))
    return out.withColumn("rate", S.ratio(F.col("exact"), F.col("examples")))


def nearest_rank(df: DataFrame, value: str, by: list[str], percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """count, mean and nearest-rank percentiles of a value by group.

    A rank is ceil(p / 100 * n). Values are counted first, and the counts are summed up by ranges of the whole order, so
    that a group of any number of distinct values is no single task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = cumulated(counts, [*map(F.col, by), F.col(value)], "_n", "_up")
    totals = upto.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), F.min(F.col("_up") - F.col("_n")).alias("_before"))
    found = upto.join(totals, by) if by else upto.crossJoin(totals)  # one row
    at = [F.min(F.when(F.col("_up") - F.col("_before") >= F.ceil(F.lit(p) * F.col("n") / 100), F.col(value))).alias(f"p{p}") for p in percents]
    return found.groupBy(*by, "n", "mean").agg(*at)


ERROR_CATEGORIES = ["typo", "abbreviation", "rt_rw", "landmark", "missing_field", "conflict", "ambiguous_region", "other_surface_form"]


def error_matrix(cases: DataFrame, key: str, categories: list[str] | None = None) -> DataFrame:
    """For each category its exposure, cases, rate, critical failures and severity; cases has key, categories, failed and critical."""
    categories = categories or ERROR_CATEGORIES
    each = cases.select(key, F.explode("categories").alias("category"), "failed", "critical")
    found = each.groupBy("category").agg(F.count(F.lit(1)).alias("exposure"), F.count_if("failed").alias("cases"), F.count_if(F.col("failed") & F.col("critical")).alias("critical_failures"))
    out = cases.sparkSession.createDataFrame([(c,) for c in categories], "category string").join(found, "category", "left").na.fill(0)
    severity = F.when(F.col("category").isin("conflict", "ambiguous_region") & (F.col("cases") > 0), "P0").when(F.col("critical_failures") >= 5, "P0").when(F.col("cases") > 0, "P1").otherwise("not_observed")
    return out.withColumn("rate", S.ratio(F.col("cases"), F.col("exposure"))).withColumn("severity", severity)


def cases_by_category(cases: DataFrame, key: str) -> DataFrame:
    """(category, key) of the failed cases behind the matrix, a row for each, so that no list has to fit in one row."""
    return cases.where("failed").select(F.explode("categories").alias("category"), key).distinct()


def round_robin(df: DataFrame, strata: list[str], order: list[Column], target: int) -> DataFrame:
    """target rows, one of each stratum in turn, strata in order of their keys. The limit is the operator's feature."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("turn", rank).where(F.col("turn") <= target).orderBy("turn", *strata).limit(target)


def proportional_split(df: DataFrame, strata: list[str], order: list[Column], share: int, total: int) -> DataFrame:
    """df with split: of each stratum half-even(n * share / total) rows are sealed, the others dev."""
    out = ranked(df, strata, order, "_r")
    return out.withColumn("split", F.when(F.col("_r") <= F.bround(F.col("_size") * share / total), "sealed").otherwise("dev")).drop("_r", "_size")


def leakage(df: DataFrame, base: Column, split: str) -> DataFrame:
    """(base_id, n_splits): bases that come in more than one split."""
    return df.groupBy(base.alias("base_id")).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def dedupe(df: DataFrame, keys: list[Column], ordinal: str, counter: str) -> DataFrame:
    """The first row of each key by ordinal, and how many there are."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = F.struct(*[F.col(c) for c in df.columns])
    return df.select(*[k.alias(n) for k, n in zip(keys, names)], rows.alias("_row"), F.col(ordinal).alias("_o")).groupBy(*names).agg(F.min_by("_row", "_o").alias("_row"), F.count(F.lit(1)).alias(counter)).select("_row.*", counter)


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, lat, lon): each way's first node, in its order, that nodes has; ways without one are left out."""
    refs = ways.select("way_id", F.posexplode("node_ids").alias("pos", "node_id"))
    return refs.join(nodes, "node_id").groupBy("way_id").agg(F.min_by(F.struct("lat", "lon"), "pos").alias("p")).select("way_id", "p.lat", "p.lon")


def delta_decoded(df: DataFrame, by: str, order: list[str], delta: str) -> DataFrame:
    """df with value, the running sum of a delta-coded column."""
    return df.withColumn("value_sum", F.sum(delta).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def rule_hits(files: DataFrame, rules: dict[str, str], allowed: DataFrame | None = None, key: str = "path") -> DataFrame:
    """(key, line, rule): lines that match a rule, without allowed (key, rule) pairs; all rules go over each line once."""
    lines = files.select(key, F.posexplode(F.split("text", "\n")).alias("line", "_t"))
    hits = F.array_compact(F.array(*[F.when(F.col("_t").rlike(p), F.lit(name)) for name, p in rules.items()]))
    out = lines.select(key, (F.col("line") + 1).alias("line"), F.explode(hits).alias("rule"))
    return out if allowed is None else out.join(allowed, [key, "rule"], "left_anti")


def first_subword(word_ids: str, labels: str) -> Column:
    """Label ids for sub-words: the word's at its first one, -100 elsewhere and for null word ids."""
    return F.expr(f"transform(`{word_ids}`, (word, i) -> if(word is null or (i > 0 and `{word_ids}`[i - 1] <=> word), '-100', cast(`{labels}`[word] as string)))")


def candidate_gates(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """df with failed_gates and selected: every gate must hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in gates.items()]))
    return df.withColumn("failed_gates", F.array_join(failed, ";")).withColumn("selected", F.size(failed) == 0)


def word_predictions(word_ids: str, labels: str) -> Column:
    """One label for each word: that of its first sub-word, in order of the words."""
    first = F.expr(f"transform(`{word_ids}`, (word, i) -> word is not null and (i = 0 or not (`{word_ids}`[i - 1] <=> word)))")
    return F.filter(F.zip_with(first, labels, lambda f, l: F.when(f, l)), lambda l: l.isNotNull())


def recall(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(positives, hits, recall) of a binary label."""
    return df.agg(F.count_if(gold).alias("positives"), F.count_if(F.col(gold) & F.col(predicted)).alias("hits")).withColumn("recall", S.ratio(F.col("hits"), F.col("positives")))


def false_correction_rate(df: DataFrame, correct: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("corrections"), F.count_if(~F.col(correct)).alias("false_corrections")).withColumn("rate", S.ratio(F.col("false_corrections"), F.col("corrections")))


def one_per_category(df: DataFrame, key: str, categories: str, order: Column, target: int) -> DataFrame:
    """The first row of each category in order, filled up to target with the next ones. The target is the operator's feature."""
    first = df.select(key, order.alias("_o"), F.explode(categories).alias("_c")).groupBy("_c").agg(F.min(F.struct("_o", key)).alias("_f")).select(F.col(f"_f.{key}").alias(key)).distinct().withColumn("_must", F.lit(True))
    return df.join(first, key, "left").orderBy(F.col("_must").isNull(), order, key).limit(target).drop("_must")


def failure_signatures(df: DataFrame, signature: list[str], damage: str, key: str, most: int) -> DataFrame:
    """The worst row of each signature, the worst of them first, most at most. The limit is the operator's feature."""
    row = F.struct(*[F.col(c) for c in df.columns])
    worst = df.groupBy(*signature).agg(F.min_by(row, F.struct(-F.col(damage), F.col(key))).alias("_r")).select("_r.*")
    return worst.orderBy(F.desc(damage), key).limit(most)


def contiguous_runs(df: DataFrame, by: str, position: str) -> DataFrame:
    """(by, start, end) of runs of neighbouring positions, end exclusive."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(by).orderBy(position))
    return df.select(by, position).distinct().withColumn("_g", island).groupBy(by, "_g").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("_g")


def coverage_report(paths: DataFrame, covered: DataFrame) -> DataFrame:
    """(path, modules, uncovered): each path's modules that no test covers; paths has path and modules, covered has module."""
    each = paths.select("path", F.explode("modules").alias("module")).join(covered.select("module", F.lit(True).alias("_c")).distinct(), "module", "left")
    return each.groupBy("path").agg(F.count(F.lit(1)).alias("modules"), F.array_sort(F.collect_set(F.when(F.col("_c").isNull(), F.col("module")))).alias("uncovered"))


def sorted_spans(found: Column | str) -> Column:
    """An array of spans (type, start, end) in order of start, then end, then type."""
    col = S.col(found)
    keyed = F.transform(col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end")))


#: What an action register asks for: id, priority, the component that owns it, and which cases are its evidence.
ACTIONS = [("A01", "P0", "validator"), ("A02", "P0", "generator"), ("A03", "P1", "model"), ("A04", "P1", "annotation")]


def action_cases(cases: DataFrame, key: str) -> DataFrame:
    """(action_id, key): the cases behind each action, a row for each, so that no list has to fit in one row.

    cases has n_repairs, components, categories and provenance: repairs are the validator's, generator cases the
    generator's, landmarks the model's, and automated labels that were accepted are to be looked at again.
    """
    tests = [F.col("n_repairs") > 0, F.array_contains("components", "generator"), F.array_contains("categories", "landmark"), F.col("provenance") == "automated_accepted"]
    hit = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(a)) for (a, _, _), t in zip(ACTIONS, tests)]))
    return cases.select(F.explode(hit).alias("action_id"), key)


def action_register(cases: DataFrame, key: str) -> DataFrame:
    """(action_id, priority, owner, evidence_cases): all actions, also those without a case."""
    counts = action_cases(cases, key).groupBy("action_id").agg(F.countDistinct(key).alias("evidence_cases"))
    every = cases.sparkSession.createDataFrame(ACTIONS, "action_id string, priority string, owner string")
    return every.join(counts, "action_id", "left").na.fill(0, ["evidence_cases"])
