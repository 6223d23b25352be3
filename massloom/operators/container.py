"""A study's three tables together: checked, mapped to sample types, sorted, subset and put back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massloom.operators import curation, matrix
from massloom.operators.graph import positions

#: fixed values: the sample types that a mapping may name
SAMPLE_TYPES = ("qc", "blank", "sample", "dqc")


class MissingMetadata(ValueError):
    """A column or value that an operation needs isn't there."""


class InvalidMapping(ValueError):
    """The mapping names an unknown sample type or class, or one class twice."""


def _checked(mapping: dict[str, Sequence[str]] | None, known: set[str]) -> dict[str, list[str]]:
    out = {k: list(v) for k, v in (mapping or {}).items()}
    if unknown := set(out) - set(SAMPLE_TYPES):
        raise InvalidMapping(f"unknown sample types: {', '.join(sorted(unknown))}")
    named = [c for v in out.values() for c in v]
    if len(set(named)) < len(named):
        raise InvalidMapping("a class belongs to one sample type")
    if missing := set(named) - known:
        raise InvalidMapping(f"no samples of class {', '.join(sorted(missing))}")
    return out


@dataclass(frozen=True)
class Study:
    """Long matrix (sample, feature, value), features (feature, mz, rt, ...) and samples (sample, class, ...).

    A study never changes: each operation returns another one that knows the first
    tables, to which ``reset`` goes back. Nothing is computed until a table is used.
    """

    matrix: DataFrame
    features: DataFrame
    samples: DataFrame
    mapping: dict[str, list[str]]
    original: tuple[DataFrame, DataFrame, DataFrame, dict[str, list[str]]]
    sorted_by: tuple[str | None, str | None] = (None, None)

    @classmethod
    def of(cls, matrix_: DataFrame, features: DataFrame, samples: DataFrame, mapping: dict[str, Sequence[str]] | None = None) -> Study:
        """Checks the tables, with one aggregation of each, and gives missing order and batch their defaults.

        Raises MissingMetadata for a column that must be there or a sample or feature
        of the matrix without metadata, ValueError for values below 0. Missing values,
        and NaN, are NULL from here on.
        """
        for table, name, needs in ((matrix_, "matrix", ("sample", "feature", "value")), (features, "features", ("feature", "mz", "rt")), (samples, "samples", ("sample", "class"))):
            if lacks := [c for c in needs if c not in table.columns]:
                raise MissingMetadata(f"{name} lacks {', '.join(lacks)}")
        m = matrix_.withColumn("value", matrix.null_if_nan(F.col("value").cast("double")))
        below = lambda c: F.coalesce(F.bool_or(F.col(c) < 0), F.lit(False))
        if m.agg(below("value")).first()[0]:
            raise ValueError("values of the matrix are at least 0")
        bad = features.agg(below("mz"), below("rt"), F.count_if(F.col("mz").isNull() | F.col("rt").isNull())).first()
        if bad[0] or bad[1] or bad[2]:
            raise ValueError("mz and rt of features are given and at least 0")
        for axis, table in (("sample", samples), ("feature", features)):
            if lost := m.select(axis).distinct().join(table.select(axis), axis, "left_anti").take(1):
                raise MissingMetadata(f"no metadata of {axis} {lost[0][0]}")
        if "ord" not in samples.columns:
            samples = matrix.default_order(samples)
        classes = {r[0] for r in samples.select("class").distinct().collect()}
        named = _checked(mapping, classes)
        return cls(m, features, samples, named, (m, features, samples, named))

    def _with(self, **changed: object) -> Study:
        return Study(**({k: getattr(self, k) for k in ("matrix", "features", "samples", "mapping", "original", "sorted_by")} | changed))

    def reset(self, mapping: bool = True) -> Study:
        """The tables as they were first; with ``mapping`` the first mapping too."""
        m, f, s, named = self.original
        return self._with(matrix=m, features=f, samples=s, mapping=named if mapping else self.mapping, sorted_by=(None, None))

    def mapped(self, mapping: dict[str, Sequence[str]]) -> Study:
        """With another mapping of sample types to classes."""
        return self._with(mapping=_checked(mapping, {r[0] for r in self.samples.select("class").distinct().collect()}))

    def classes_of(self, kind: str) -> list[str]:
        """Classes of a sample type; MissingMetadata if it has none."""
        if not self.mapping.get(kind):
            raise MissingMetadata(f"no classes are mapped to {kind}")
        return self.mapping[kind]

    def sort(self, field: str, axis: str = "sample") -> Study:
        """Samples or features in the order of a metadata field, then of the name."""
        table = {"sample": self.samples, "feature": self.features}.get(axis)
        if table is None:
            raise ValueError("axis is sample or feature")
        if field not in table.columns:
            raise MissingMetadata(f"{axis}s lack {field}")
        s, f = self.sorted_by
        return self._with(sorted_by=(field, f) if axis == "sample" else (s, field))

    def ordered(self, axis: str = "sample") -> DataFrame:
        """Metadata of an axis in its order, with its position from 0 (a sort of the whole table, by request)."""
        field = self.sorted_by[axis == "feature"]
        table = self.samples if axis == "sample" else self.features
        return positions(table, [field, axis] if field else [axis])

    def column(self, name: str) -> DataFrame:
        """(sample, value) of id, class, batch, ord or dilution; MissingMetadata if it's missing."""
        if name not in self.samples.columns:
            raise MissingMetadata(f"samples lack {name}")
        return self.samples.select("sample", F.col(name).alias("value"))

    def with_column(self, name: str, values: DataFrame) -> Study:
        """Sets a column of the samples' metadata from (sample, value)."""
        new = values.select("sample", F.col("value").alias(name))
        return self._with(samples=self.samples.drop(name).join(new, "sample", "left"))

    def remove(self, names: Sequence[str], axis: str = "sample") -> Study:
        """Without the named samples or features; KeyError for names that aren't there."""
        table = self.samples if axis == "sample" else self.features
        there = {r[0] for r in table.filter(F.col(axis).isin(list(names))).select(axis).collect()}
        if unknown := set(names) - there:
            raise KeyError(f"no {axis} {', '.join(map(str, sorted(unknown)))}")
        gone = ~F.col(axis).isin(list(names))
        return self._with(matrix=self.matrix.filter(gone), **{axis + "s": table.filter(gone)})

    def groups(self) -> DataFrame:
        """(class, samples): the classes and their numbers of samples."""
        return self.samples.groupBy("class").agg(F.count(F.lit(1)).alias("samples"))

    def of_sample(self, name: object) -> dict[str, object]:
        """Metadata of one sample; KeyError if it isn't there."""
        rows = self.samples.filter(F.col("sample") == name).take(1)
        if not rows:
            raise KeyError(f"no sample {name}")
        return rows[0].asDict()

    def annotated(self) -> DataFrame:
        """The matrix with the samples' metadata beside each value, as the curation steps take it."""
        return self.matrix.join(self.samples, "sample")

    def process(self, steps: Sequence[dict], mode: str = "apply") -> Study:
        """Runs curation steps, whose classes default to the mapping's (see ``curation.build_pipeline``).

        In mode "flag" nothing is removed or changed: what a filter would remove is
        marked in a column of the features named after it.
        """
        if mode not in ("apply", "flag"):
            raise ValueError("mode is apply or flag")
        m, f = self.annotated(), self.features
        for step in steps:
            run = curation.step_of(step, self.mapping)
            curation.check_needs(run, m, self.mapping)
            if mode == "apply":
                m = run(m)
            elif run.kind == "filter":
                flagged = run.run(m, **run.parameters).select("feature").distinct().withColumn(run.name, F.lit(True))
                f = f.drop(run.name).join(flagged, "feature", "left").withColumn(run.name, F.coalesce(run.name, F.lit(False)))
        if mode == "flag":
            return self._with(features=f)
        out = m.select("sample", "feature", "value")
        return self._with(matrix=out, features=f.join(out.select("feature").distinct(), "feature", "left_semi"))


def attach_annotations(features: DataFrame, annotations: DataFrame, key: str = "feature") -> DataFrame:
    """Features with envelope_label, envelope_index, charge and count of their consensus annotation; -1 where there is none."""
    made = [c for c in ("envelope_label", "envelope_index", "charge", "count") if c in annotations.columns]
    a = annotations.groupBy(key).agg(*[F.max(c).alias(c) for c in made])
    filled: list[Column] = [F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in made]
    return features.drop(*made).join(a, key, "left").select(*[c for c in features.columns if c not in made], *filled)
