"""Chat formatting: a finite-state machine over roles and a declarative template. Column expressions only.

A template gives each role what opens and closes its turns, and which texts count for the loss. Inside texts, characters with which control strings
begin are replaced by two-character codes, so that a formatted conversation can be read back without doubt. Turns come out as segments with a loss flag:
control strings and texts are separate segments, and only texts of trained roles carry the flag.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: role -> (opening, closing). other: (opening, between role and text, closing) for roles without marks. trained: roles with loss.
    moves: state -> roles that may follow and the state is then the role; "" is the start. final: states a conversation may end in.
    codes: characters that may not stand in a text -> their code; the first begins every code."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    trained: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)
    codes: dict[str, str] = field(default_factory=lambda: {"\\": "\\b", "<": "\\l", "[": "\\k"})

    def __post_init__(self):
        lead = next(iter(self.codes))
        strings = [s for pair in self.marks.values() for s in pair] + list(self.other)
        if any(s[0] not in self.codes or s[0] == lead for s in strings) or any(c[0] != lead or len(c) != 2 for c in self.codes.values()):
            raise ValueError("every control string must begin with a coded character, and every code with the first")


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    for plain, code in template.codes.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    for plain, code in reversed(template.codes.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _literal(pattern: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_ " else c for c in pattern)


def validate(turns: Column, template: Template = TEMPLATE) -> Column:
    """Number of the first turn that the machine refuses, from 1 on; one more than there are, if the end is not final; 0 if all is well."""
    allowed = F.create_map(*[x for s, roles in template.moves.items() for x in (F.lit(s), F.array(*map(F.lit, roles)))])

    def step(s: Column, t: Column) -> Column:
        fits = F.coalesce(F.array_contains(F.element_at(allowed, s["state"]), t["role"]), F.lit(False))
        go = (s["bad"] == 0) & fits
        return F.struct(F.when(go, t["role"]).otherwise(s["state"]).alias("state"), F.when(s["bad"] > 0, s["bad"]).when(fits, 0).otherwise(s["n"] + 1).cast("int").alias("bad"), (s["n"] + 1).cast("int").alias("n"))

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("bad"), F.lit(0).alias("n"))
    return F.aggregate(turns, start, step, lambda s: F.when(s["bad"] > 0, s["bad"]).when(s["state"].isin(list(template.final)), 0).otherwise(s["n"] + 1))


def segments(turns: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<text, loss>> of turns (role, text): opening, text, closing of each."""

    def of_turn(t: Column) -> Column:
        opening = closing = None
        for role, (a, b) in template.marks.items():
            opening = F.when(t["role"] == role, a) if opening is None else opening.when(t["role"] == role, a)
            closing = F.when(t["role"] == role, b) if closing is None else closing.when(t["role"] == role, b)
        opening = opening.otherwise(F.concat(F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1])))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(opening, F.lit(False)), part(escape(t["text"], template), t["role"].isin(list(template.trained))), part(closing.otherwise(template.other[2]), F.lit(False)))

    return F.flatten(F.transform(turns, of_turn))


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> of a formatted conversation, from the string alone."""
    body = "[^" + "".join(_literal(c) for c in list(template.codes)[1:]) + "]*+"
    known = [f"{_literal(a)}{body}{_literal(b)}" for a, b in template.marks.values()]
    unknown = f"{_literal(template.other[0])}{body}{_literal(template.other[1])}{body}{_literal(template.other[2])}"
    turns = F.regexp_extract_all(formatted, F.lit("|".join([*known, unknown])), F.lit(0))

    def of_turn(t: Column) -> Column:
        found = None
        for role, (a, b) in template.marks.items():
            own = F.struct(F.lit(role).alias("role"), unescape(F.substring(t, F.lit(len(a) + 1), F.length(t) - len(a) - len(b)), template).alias("text"))
            found = F.when(F.startswith(t, F.lit(a)), own) if found is None else found.when(F.startswith(t, F.lit(a)), own)
        a, mid, b = template.other
        role = F.substring(t, F.lit(len(a) + 1), F.instr(t, mid) - 1 - len(a))
        text = F.substring(t, F.instr(t, mid) + len(mid), F.length(t) - len(b) - len(mid) - F.instr(t, mid) + 1)
        return found.otherwise(F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text")))

    return F.transform(turns, of_turn)


def format_conversations(rows: DataFrame, template: Template = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, n_turns, segments, formatted, refused) of each conversation.

    Turns go by number, then role, then text; repeated turns stay. A null text or role is empty, a null turn comes first, rows with a null id are one
    conversation. refused is what validate() says; such conversations are formatted all the same, for a filter to decide. An empty table gives an
    empty result; other columns are ignored. A conversation is one row, so a single task holds the turns of one.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.groupBy(F.col(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    found = found.select(id_col, F.size("turns").cast("long").alias("n_turns"), segments(F.col("turns"), template).alias("segments"), validate(F.col("turns"), template).alias("refused"))
    return found.select(id_col, "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "refused")
