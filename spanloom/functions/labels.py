"""Label vocabularies, code maps and label arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


@dataclass(frozen=True)
class Constraint:
    label: str
    tag: str
    attributes: Mapping[str, Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class CodeMap:
    """Constraints in order of priority; a code is a constraint's place, from 1."""

    name: str
    constraints: tuple[Constraint, ...]
    mode: str = "whole_entity"

    def __post_init__(self):
        if self.mode not in ("whole_entity", "boundary_start"):
            raise ValueError(f"unknown mode {self.mode}")

    @property
    def labels(self) -> list[str]:
        return [c.label for c in self.constraints]

    @property
    def iob2(self) -> list[str]:
        """O, then B- and I- of each label, or B- alone where only boundaries count."""
        inside = ("B-", "I-") if self.mode == "whole_entity" else ("B-",)
        return ["O", *(p + label for label in self.labels for p in inside)]

    def code(self, tag: Column, attribute) -> Column:
        """The code of an element, null if none fits. attribute: a function from an attribute's name to its column."""
        out = None
        for i, c in enumerate(self.constraints, 1):
            fits = tag == c.tag
            for name, allowed in c.attributes.items():
                fits &= F.coalesce(attribute(name).isin(*allowed), F.lit(False))
            out = F.when(fits, i) if out is None else out.when(fits, i)
        return out

    def code_of(self, tag: str, attributes: Mapping[str, str]) -> int | None:
        for i, c in enumerate(self.constraints, 1):
            if c.tag == tag and all(attributes.get(k) in allowed for k, allowed in c.attributes.items()):
                return i
        return None


# The vocabularies of the data model.
GENEPROD = ("geneprod", "gene", "protein")
ROLES = (("CONTROLLED_VAR", "intervention"), ("MEASURED_VAR", "assayed"))
GENEPROD_ROLES = CodeMap("geneprod_roles", tuple(Constraint(label, "sd-tag", {"entity_type": GENEPROD, "role": (role,)}) for label, role in ROLES))
SMALL_MOL_ROLES = CodeMap("small_mol_roles", tuple(Constraint(label, "sd-tag", {"entity_type": ("molecule",), "role": (role,)}) for label, role in ROLES))
ENTITY_TYPES = CodeMap("entity_types", (
    Constraint("SMALL_MOLECULE", "sd-tag", {"entity_type": ("molecule",)}),
    Constraint("GENEPROD", "sd-tag", {"entity_type": GENEPROD}),
    Constraint("SUBCELLULAR", "sd-tag", {"entity_type": ("subcellular",)}),
    Constraint("CELL_TYPE", "sd-tag", {"entity_type": ("cell_type",)}),
    Constraint("TISSUE", "sd-tag", {"entity_type": ("tissue",)}),
    Constraint("ORGANISM", "sd-tag", {"entity_type": ("organism",)}),
    Constraint("EXP_ASSAY", "sd-tag", {"category": ("assay",)}),
    Constraint("DISEASE", "sd-tag", {"category": ("disease",)}),
    Constraint("CELL_LINE", "sd-tag", {"entity_type": ("cell_line",)}),
))
BORING = CodeMap("boring", (Constraint("BORING", "sd-tag", {"role": ("reporter", "normalizing", "component")}),))
PANELIZATION = CodeMap("panel_start", (Constraint("PANEL_START", "sd-panel"),), "boundary_start")
CODE_MAPS = (ENTITY_TYPES, GENEPROD_ROLES, SMALL_MOL_ROLES, BORING, PANELIZATION)
#: The seven classes of published datasets.
DATASET_CLASSES = ("SMALL_MOLECULE", "GENEPROD", "SUBCELLULAR", "CELL", "TISSUE", "ORGANISM", "EXP_ASSAY")
# Parts of speech of masks.
POS_MASKS = {"DET": ("DET",), "VERB": ("VERB",), "NOUN": ("NOUN",), "SMALL": ("DET", "CCONJ", "SCONJ", "ADP", "PRON")}


def iob2_index(code: int, inside: bool) -> int:
    """Place of a code's label in the IOB2 list."""
    return 2 * code if inside else 2 * code - 1


def prefix(label: Column) -> Column:
    """B or I; a label without prefix counts as I."""
    return F.when(label.startswith("B-"), "B").otherwise("I")


def bare(label: Column) -> Column:
    return F.when(F.substring(label, 1, 2).isin("B-", "I-"), F.substring(label, 3, 1 << 30)).otherwise(label)


def shifted(label: Column) -> Column:
    """The label id for the following sub-words: a B's I, others as they are."""
    return F.when((label > 0) & (label % 2 == 1), label + 1).otherwise(label)


def mask(labels: Column | str, wanted: Iterable) -> Column:
    """1 where a label is wanted, else 0."""
    keep = list(wanted)
    return F.transform(F.col(labels) if isinstance(labels, str) else labels, lambda x: F.when(x.isin(*keep), 1).otherwise(0))


def nonzero_mask(labels: Column | str) -> Column:
    """1 where a label id is above 0; ignored positions are 0."""
    return F.transform(F.col(labels) if isinstance(labels, str) else labels, lambda x: F.when(x > 0, 1).otherwise(0))


def subset(labels: Column | str, chosen: Mapping[int, int]) -> Column:
    """Label ids mapped to those of chosen labels, others to 0; ignored positions stay."""
    pairs = [F.lit(x) for kv in chosen.items() for x in kv]
    table = F.create_map(*pairs)
    return F.transform(F.col(labels) if isinstance(labels, str) else labels, lambda x: F.when(x == IGNORE, x).otherwise(F.coalesce(table[x], F.lit(0))))


def category(entity_group: Column) -> tuple[Column, Column]:
    """Type and category of an entity group: assays and diseases are categories, the rest types."""
    low = F.lower(entity_group)
    cat = F.when(entity_group == "EXP_ASSAY", "assay").when(entity_group == "DISEASE", "disease")
    return F.when(cat.isNull(), low), cat
