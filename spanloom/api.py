"""Texts to tagged panels in one call, with pluggable scorers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import labels as lb
from .operators import inference as inf
from .operators import labelseq as ls
from .operators import tokens as tk
from .sources import readers


@dataclass(frozen=True)
class Lexicon:
    """A deterministic scorer: words to labels, panel starts by '(' before a single capital, roles by the words around."""

    entities: Mapping[str, str] = field(default_factory=dict)
    roles: Mapping[str, str] = field(default_factory=dict)

    def entity(self, word: F.Column) -> F.Column:
        if not self.entities:
            return F.lit("O")
        table = F.create_map(*[F.lit(x) for kv in self.entities.items() for x in (kv[0].lower(), kv[1])])
        return F.coalesce(table[F.lower(word)], F.lit("O"))

    def role(self, text: F.Column) -> F.Column:
        if not self.roles:
            return F.lit(None).cast("string")
        table = F.create_map(*[F.lit(x) for kv in self.roles.items() for x in (kv[0].lower(), kv[1])])
        return table[F.lower(text)]


class TextTagger:
    """Segments texts into panels, recognises entities, assigns roles, and gives JSON.

    Tokens, panel tags and entity tags are columns, so a model behind
    inference.score() can take a lexicon's place: it returns the tokens with a
    panel_tag and an entity_tag.
    """

    def __init__(self, spark: SparkSession, lexicon: Lexicon | None = None, tag=None):
        self.spark, self.lexicon, self.tag = spark, lexicon or Lexicon(), tag

    def tagged_tokens(self, docs: DataFrame) -> DataFrame:
        t = tk.tokens(docs)
        if self.tag is not None:
            return self.tag(t)
        w = Window.partitionBy("doc_id").orderBy("pos")
        starts = (F.col("word") == "(") & F.lead("word").over(w).rlike("^[A-Z]$") & (F.lead("word", 2).over(w) == ")")
        t = t.withColumns({"panel_tag": F.when(starts, "B-PANEL_START").otherwise("O"), "label": self.lexicon.entity(F.col("word"))})
        return ls.iob2(t, "label", name="entity_tag")

    def __call__(self, texts: Sequence[str] | DataFrame) -> DataFrame:
        """doc_id, tagged (JSON) for every text; one without words has no panels."""
        docs = (texts if isinstance(texts, DataFrame) else readers.inline(self.spark, list(texts))).select("doc_id", "text")
        tagged = self.tagged_tokens(docs)
        panels = inf.panels(inf.group_entities(tagged, "doc_id", "pos", "panel_tag"), "doc_id")
        groups = inf.group_entities(tagged, "doc_id", "pos", "entity_tag").where("entity_group <> 'O'")
        held = inf.entities_in_panels(groups, panels, "doc_id").join(docs, "doc_id")
        held = held.withColumn("text", F.expr("substring(text, int(start) + 1, int(end - start))")).where("text <> '-'")
        kind, category = lb.category(F.col("entity_group"))
        entities = held.select("doc_id", "panel", "start", "end", "text", F.coalesce(kind, category).alias("type"), self.lexicon.role(F.col("text")).alias("role"))
        found = inf.tagged_json(panels, entities, "doc_id")
        return docs.select("doc_id").join(found, "doc_id", "left").withColumn("tagged", F.coalesce("tagged", F.lit("[]")))

    tag_texts = __call__
