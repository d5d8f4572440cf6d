"""Model answers found by what was asked: equal texts are asked once, and never again.

An answer is kept under the hash of its text and the name of the model. A run first reduces its rows to the
distinct texts that have no answer yet, asks the model for these, and joins all answers back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Model, apply_model
from ..session import stage
from .skew import near_keys

#: Column an answer is kept in, by the type the model returns.
COLUMNS = {"string": "response", "array<float>": "embedding"}


@dataclass
class AnswerBook:
    """``stored(key, model, response, embedding)`` and what a run adds to it.

    ``calls`` counts the texts a model was asked for, by its name; a text it failed on is asked again next time.
    """

    stored: DataFrame
    fresh: list[DataFrame] = field(default_factory=list)
    calls: dict[str, int] = field(default_factory=dict)

    def numbered(self, rows: DataFrame) -> DataFrame:
        """``rows`` staged with the number ``_row``, as ``ask`` takes them; whole texts are written this once for all models."""
        return stage(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")

    def ask(self, rows: DataFrame, text: Column, answer: str, model: Model, name: str, returns: str) -> DataFrame:
        """``numbered`` rows with the column ``answer`` for their ``text``; a null text has none.

        ``rows`` are read three times, twice only as far as ``text`` needs it, and must give the same again: what is costly or
        differs by run belongs before ``numbered``. Which texts are missing is found on hashes alone, and of each the first row
        that has it is sent to the model from where it lies. Rows without a text are not joined. A text may stand in any share
        of the rows: the answers have one row per text.
        """
        column = COLUMNS[returns]
        keyed, without = rows.filter(text.isNotNull()).withColumn("_key", F.sha2(text, 256)), rows.filter(text.isNull())
        wanted = keyed.groupBy("_key").agg(F.min("_row").alias("_row"))
        own = self.stored.filter((F.col("model") == name) & F.col(column).isNotNull()).select(F.col("key").alias("_key"), column)
        known = own.join(wanted.select("_key"), "_key", "left_semi")
        missing = stage(wanted.join(known.select("_key"), "_key", "left_anti").select("_row"), "missing")
        self.calls[name] = self.calls.get(name, 0) + missing.count()
        asked = keyed.join(near_keys(missing)[0], "_row", "left_semi").select("_key", apply_model(model, text, returns).alias(column))
        made = stage(asked, "answers").filter(F.col(column).isNotNull())
        columns = {c: F.col(c) if c == column else F.lit(None).cast(t) for t, c in COLUMNS.items()}
        self.fresh.append(made.select(F.col("_key").alias("key"), F.lit(name).alias("model"), *[v.alias(c) for c, v in columns.items()]))
        answers = known.unionByName(made.select("_key", column)).withColumnRenamed(column, answer)
        none = F.lit(None).cast(returns).alias(answer)
        return keyed.join(answers, "_key", "left").drop("_key").unionByName(without.select("*", none))

    def additions(self) -> DataFrame:
        """The answers of this run that were not stored before."""
        rows = self.stored.limit(0)
        for made in self.fresh:
            rows = rows.unionByName(made)
        return rows
