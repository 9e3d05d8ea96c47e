"""Synthetic labelled addresses: chains of a hierarchy, hashed choices, noisy variants, BIO labels and splits.

All choices hang on a hash of (seed, id, purpose), so a row comes out the same on any number of machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapal.functions import scalar as S
from tapal.operators.ranking import numbered

STREETS = ["Mawar", "Melati", "Merdeka", "Asia Afrika", "Veteran", "Pahlawan", "Cendana", "Kenanga"]


def uniform(seed: int, purpose: str, *keys: str) -> Column:
    """A number in [0, 1) that hangs on the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *[F.col(k) for k in keys]), F.lit(1_000_000)) / 1_000_000.0


def pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def base_addresses(chains: DataFrame, n: int, seed: int) -> DataFrame:
    """n addresses over the chains (village_name, district_name, city_name, province_name, postal_code) in turn; base_id tells them apart."""
    spark = chains.sparkSession
    hashed = chains.select("*", F.xxhash64(F.lit(seed), "village_code").alias("_h"))
    ranked = numbered(hashed, [F.col("_h"), F.col("village_code")], "_i").drop("_h")
    total = chains.count()
    ids = spark.range(n).select(F.col("id").alias("base_id"), (F.pmod("id", F.lit(total)) + 1).alias("_i"))
    out = ids.join(ranked, "_i").drop("_i")
    u = lambda purpose: uniform(seed, purpose, "base_id")
    out = out.withColumn("street", pick(STREETS, u("street"))).withColumn("number", (F.floor(u("number") * 200) + 1).cast("string"))
    return out.withColumn("rt", F.when(u("has_rt") < 0.5, F.lpad((F.floor(u("rt") * 20) + 1).cast("string"), 2, "0"))).withColumn("rw", F.when(u("has_rt") < 0.5, F.lpad((F.floor(u("rw") * 20) + 1).cast("string"), 2, "0")))


def typo(x: Column, u: Column) -> Column:
    """A word of five letters or more with one letter dropped, doubled or swapped."""
    at = (F.floor(u * 1000) % F.greatest(F.length(x) - 2, F.lit(1)) + 2).cast("int")
    left, one, two, rest = F.substring(x, F.lit(1), at - 1), F.substring(x, at, F.lit(1)), F.substring(x, at + 1, F.lit(1)), F.substring(x, at + 2, F.length(x))
    kind = F.floor(u * 3)
    return F.when(F.length(x) < 5, x).when(kind == 0, F.concat(left, two, rest)).when(kind == 1, F.concat(left, one, one, two, rest)).otherwise(F.concat(left, two, one, rest))


def variants(bases: DataFrame, n: int, seed: int) -> DataFrame:
    """(base_id, variant, example_id, tokens, labels, noise): n noisy forms of each base, tokens with their BIO labels."""
    df = bases.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("variant"))
    u = lambda purpose: uniform(seed, purpose, "base_id", "variant")
    short = u("short") < 0.4
    wrong = u("typo") < 0.25

    def part(field: str, words: Column) -> Column:
        own = F.filter(F.split(words, " "), lambda w: w != "")
        return F.transform(own, lambda w, i: F.struct(w.alias("t"), F.concat(F.when(i == 0, "B-").otherwise("I-"), F.lit(field)).alias("l")))

    comma = F.when(u("comma") < 0.7, F.array(F.struct(F.lit(",").alias("t"), F.lit("O").alias("l")))).otherwise(F.array().cast("array<struct<t:string,l:string>>"))
    none = F.array().cast("array<struct<t:string,l:string>>")
    village = F.when(wrong, typo(F.col("village_name"), u("where"))).otherwise(F.col("village_name"))
    slots = [
        part("JALAN", F.concat(F.when(short, "Jl. ").otherwise("Jalan "), "street")), part("NOMOR", F.concat(F.lit("No. "), "number")), comma,
        F.when(F.col("rt").isNotNull(), F.concat(part("RT", F.concat(F.lit("RT "), "rt")), part("RW", F.concat(F.lit("RW "), "rw")), comma)).otherwise(none),
        part("KELURAHAN", F.concat(F.when(short, "Kel. ").otherwise("Kelurahan "), village)), comma, part("KECAMATAN", F.concat(F.when(short, "Kec. ").otherwise("Kecamatan "), "district_name")), comma,
        part("KOTA_KABUPATEN", F.col("city_name")), comma, F.when(u("province") < 0.7, part("PROVINSI", F.col("province_name"))).otherwise(none), F.when(u("postal") < 0.8, part("KODEPOS", F.col("postal_code"))).otherwise(none),
    ]
    noise = F.array_compact(F.array(F.when(short, F.lit("abbreviation")), F.when(wrong, F.lit("typo")), F.when(u("case") < 0.2, F.lit("case"))))
    df = df.withColumn("_s", F.concat(*slots)).withColumn("noise", noise)
    lower = F.array_contains("noise", "case")
    return df.select("base_id", "variant", F.format_string("%08d-%02d", "base_id", "variant").alias("example_id"), F.transform("_s", lambda s: F.when(lower, F.lower(s["t"])).otherwise(s["t"])).alias("tokens"), F.transform("_s", lambda s: s["l"]).alias("labels"), "noise")


def with_splits(examples: DataFrame, seed: int, shares: dict[str, float]) -> DataFrame:
    """examples with split; all variants of a base have the same one."""
    u, out, upto = uniform(seed, "split", "base_id"), F.lit(None).cast("string"), 0.0
    for name, share in shares.items():
        upto += share
        out = F.coalesce(out, F.when(u < upto, name))
    return examples.withColumn("split", F.coalesce(out, F.lit(list(shares)[-1])))


def noise_distribution(examples: DataFrame) -> DataFrame:
    return examples.select(F.explode("noise").alias("noise")).groupBy("noise").agg(F.count(F.lit(1)).alias("n"))


def text_of(examples: DataFrame) -> DataFrame:
    return examples.withColumn("text", S.detokenized("tokens"))
