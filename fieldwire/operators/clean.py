"""Column selection, cleaning, imputation and label handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import (
    BENIGN, COLLAPSE_MAP, FLOW_RENAME, IDENTIFIER_COLUMNS, PAYLOAD_CLASSES,
)
from ..functions.net import touches_port
from .ordered import exact_quantiles, row_numbers


def quoted(name: str) -> Column:
    """Column by its exact name; flow names hold dots, blanks and slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def rename_flow_columns(df: DataFrame) -> DataFrame:
    """Extractor names to model names; unknown names stay."""
    return df.withColumnsRenamed({k: v for k, v in FLOW_RENAME.items() if k in df.columns})


def drop_identifiers(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if c not in IDENTIFIER_COLUMNS])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_only(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns plus those in ``keep``, in their order."""
    wanted = set(numeric_columns(df)) | set(keep)
    return df.select(*[quoted(c) for c in df.columns if c in wanted])


def align_columns(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns both sides have, in train order."""
    common = [c for c in train.columns if c in set(test.columns)]
    if not common:
        raise ValueError("train and test share no column")
    cols = [quoted(c) for c in common]
    return train.select(*cols), test.select(*cols)


def require_features(df: DataFrame, features: list[str], label: str | None = None) -> DataFrame:
    """Features (and label) in the asked order; an absent one is an error."""
    wanted = features + ([label] if label else [])
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*[quoted(c) for c in wanted])


def zero_fill_missing(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Add absent features as 0; the second result names them."""
    missing = [c for c in features if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in missing}), missing


def finite_or_null(c: Column) -> Column:
    """Null for NaN and both infinities."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), c)


def nonfinite_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns if columns is not None else [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: finite_or_null(quoted(c)) for c in cols})


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians; null for a column without values."""
    plain = df.select(*[finite_or_null(quoted(c)).cast("double").alias(f"c{i}")
                        for i, c in enumerate(columns)])
    found = exact_quantiles(plain, plain.columns, [0.5])
    return {c: found[f"c{i}"][0] for i, c in enumerate(columns)}


def fill_with(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Fill nulls and non-finite values by column; a column without a value stays null."""
    return df.withColumns({
        c: F.coalesce(finite_or_null(quoted(c)).cast("double"), F.lit(v).cast("double"))
        for c, v in values.items()
    })


def impute_train_median(
    train: DataFrame, test: DataFrame, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Train medians fill both sets."""
    values = medians(train, columns)
    return fill_with(train, values), fill_with(test, values)


def impute_own_median(df: DataFrame, columns: list[str]) -> DataFrame:
    return fill_with(df, medians(df, columns))


def impute_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return fill_with(df, dict.fromkeys(columns, 0.0))


def lenient_number(c: Column) -> Column:
    """Text as DOUBLE; missing, unparsable or non-finite becomes 0."""
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.coalesce(finite_or_null(number), F.lit(0.0))


def impute_lenient(df: DataFrame, features: list[str]) -> DataFrame:
    """Every feature to a finite number, absent columns included."""
    types = {f.name: f.dataType for f in df.schema}

    def number(c: str) -> Column:
        if c not in types:
            return F.lit(0.0)
        if isinstance(types[c], T.NumericType):
            return F.coalesce(finite_or_null(quoted(c)).cast("double"), F.lit(0.0))
        return lenient_number(quoted(c))

    return df.withColumns({c: number(c) for c in features})


def to_float32(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: quoted(c).cast("float") for c in columns})


def port_filter(df: DataFrame, port: int, src="src_port", dst="dst_port") -> DataFrame:
    return df.where(touches_port(F.col(src), F.col(dst), port))


def collapsed(label: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in COLLAPSE_MAP.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, label), label)


def collapse_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    """The five function-code classes become one."""
    return df.withColumn(label, collapsed(quoted(label)))


def behavioral_only(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.where(~quoted(label).isin(PAYLOAD_CLASSES))


def payload_classes_only(df: DataFrame, label: str = "Label") -> tuple[DataFrame, DataFrame]:
    """Rows of the payload classes and NORMAL; and the sorted labels left out."""
    kept = quoted(label).isin([*PAYLOAD_CLASSES, BENIGN])
    return df.where(kept), df.where(~kept).select(quoted(label)).distinct().orderBy(quoted(label))


def binary_label(label: Column) -> Column:
    return (label != F.lit(BENIGN)).cast("int")


def split_null_labels(df: DataFrame, label: str = "Label") -> tuple[DataFrame, DataFrame]:
    """Labelled rows, and rows without a label for a side table."""
    return df.where(quoted(label).isNotNull()), df.where(quoted(label).isNull())


def label_set(*frames: DataFrame, label: str = "Label") -> DataFrame:
    """Sorted distinct labels over all frames."""
    both = reduce(DataFrame.unionByName, [f.select(quoted(label)) for f in frames])
    return both.where(quoted(label).isNotNull()).distinct().orderBy(quoted(label))


def label_table(labels: DataFrame, label: str = "Label") -> DataFrame:
    """``label`` and its ``label_code``, 0..k-1 in sorted order, for any number of labels."""
    found = labels.select(quoted(label).alias("__label")).where("__label IS NOT NULL").distinct()
    rows = row_numbers(found, ["__label"], F.ascii("__label"), "__code")
    return rows.select(F.col("__label").alias(label), (F.col("__code") - 1).cast("int").alias("label_code"))


def label_codes(labels: DataFrame, label: str = "Label") -> dict[str, int]:
    """The codes of :func:`label_table` for a model, whose classes the driver must hold anyway."""
    return {v: i for i, v in enumerate(sorted(r[0] for r in labels.distinct().collect()))}


def encode_labels(
    df: DataFrame, codes: dict[str, int] | DataFrame, label="Label", out="label_code"
) -> DataFrame:
    """Add the code; an unknown or null label gets null."""
    if isinstance(codes, dict):
        table = F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])
        return df.withColumn(out, F.try_element_at(table, quoted(label)))
    named = codes.toDF("__label", "__code")
    coded = df.withColumn("__key", quoted(label)).join(named, F.col("__key") == F.col("__label"), "left")
    return coded.withColumn(out, F.col("__code")).drop("__key", "__label", "__code")


def decode_labels(
    df: DataFrame, codes: dict[str, int] | DataFrame, code="label_code", out="Label"
) -> DataFrame:
    """Label of a code; ``<unk:i>`` for a code outside the table."""
    c = quoted(code).cast("int")
    unknown = F.format_string("<unk:%d>", c)
    if isinstance(codes, dict):
        table = F.create_map(*[F.lit(v) for k, i in codes.items() for v in (i, k)])
        return df.withColumn(out, F.coalesce(F.try_element_at(table, c), unknown))
    named = codes.toDF("__label", "__code")
    coded = df.withColumn("__key", c).join(named, F.col("__key") == F.col("__code"), "left")
    return coded.withColumn(out, F.coalesce("__label", unknown)).drop("__key", "__label", "__code")


def pick_classes(df: DataFrame, only: str, label: str = "Label") -> DataFrame:
    """Case-insensitive subset from a comma-separated list; an empty result is an error."""
    wanted = [x.strip().upper() for x in only.split(",") if x.strip()]
    out = df.where(F.upper(quoted(label)).isin(wanted))
    if not wanted or out.isEmpty():
        raise ValueError(f"no class matches {only!r}")
    return out


def verdict_kind(label: Column, covered: Column, correlated: bool = True) -> Column:
    """ok / ALERT / ALERT-AI / SUPPRESS."""
    alert = F.lit("ALERT-AI" if correlated else "ALERT")
    kind = F.when(label == F.lit(BENIGN), F.lit("ok"))
    return (kind.when(covered, F.lit("SUPPRESS")) if correlated else kind).otherwise(alert)


def union_datasets(*frames: DataFrame) -> DataFrame:
    """All rows; a column one side lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
