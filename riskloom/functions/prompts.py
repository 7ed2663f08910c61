"""Prompt texts by domain and style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt wordings.
MCQ_HEAD = (
    "Answer the following medical question by selecting the correct option (A, B, C, or D). "
    "Reply with ONLY the letter of the correct answer.\n\n"
)
GROUNDED_HEAD = (
    "Answer the following question based ONLY on the provided context. Be concise and accurate.\n\n"
)
INSTRUCTIONS = {
    "Medicine": ("Answer the following medical question accurately.\n\nQuestion: ", "\n\nAnswer:"),
    "Math": ("Solve the following math problem step by step.\n\nProblem: ", "\n\nSolution:"),
    "Finance": ("Answer the following financial question.\n\nQuestion: ", "\n\nAnswer:"),
    "IS": ("Task: ", "\n\nResponse:"),
    "Psychology": ("Answer the following question truthfully and accurately.\n\nQuestion: ", "\n\nAnswer:"),
}
GENERIC_INSTRUCTION = ("Question: ", "\n\nAnswer:")
GENERIC_CHAT = ("<|user|>\n", "\n<|assistant|>\n")


def _wrap(pair: tuple[str, str], question: Column) -> Column:
    return F.concat(F.lit(pair[0]), question, F.lit(pair[1]))


def plain_prompt(question: Column, domain: Column, style: str = "simple") -> Column:
    """Question in the domain's wording.  Only an unknown domain has a chat form."""
    if style == "instruction":
        out = _wrap(GENERIC_INSTRUCTION, question)
        for name, pair in INSTRUCTIONS.items():
            out = F.when(domain == name, _wrap(pair, question)).otherwise(out)
        return out
    if style == "chat":
        return F.when(domain.isin(*INSTRUCTIONS), question).otherwise(_wrap(GENERIC_CHAT, question))
    return question


def parse_options(literal: Column) -> Column:
    """Quoted key/value text, single or double quotes, to ``map<string,string>``.

    Bare ``None``, ``True`` and ``False`` become the words that a prompt shows for them; only text that
    doesn't parse as it stands is read so.
    """
    def read(text: Column) -> Column:
        return F.from_json(text, "map<string,string>", {
            "allowSingleQuotes": "true", "allowUnquotedControlChars": "true",
            "allowBackslashEscapingAnyCharacter": "true"})

    quoted = F.regexp_replace(literal, r"(:\s*)(None|True|False)(?=\s*[,}])", '$1"$2"')
    return F.coalesce(read(literal), read(quoted))


def mcq_prompt(question: Column, options: Column) -> Column:
    """Multiple-choice wording; only digit keys are options, in numeric order."""
    numbered = F.map_filter(options, lambda k, _: k.rlike("^[0-9]+$"))
    keyed = F.transform(F.map_entries(numbered),
                        lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v")))
    lines = F.transform(F.array_sort(keyed),
                        lambda e: F.concat(F.char(e["k"] + 65), F.lit(") "), e["v"], F.lit("\n")))
    return F.concat(F.lit(MCQ_HEAD + "Question: "), question, F.lit("\n"),
                    F.array_join(lines, ""), F.lit("\nAnswer:"))


def grounded_prompt(question: Column, documents: Column) -> Column:
    return F.concat(F.lit(GROUNDED_HEAD + "Context: "), documents, F.lit("\n\nQuestion: "),
                    question, F.lit("\n\nAnswer:"))


def format_prompt(question: Column, domain: Column, style: str = "simple",
                  options: Column | None = None, documents: Column | None = None) -> Column:
    """Medicine with options becomes multiple choice, Finance and IS with documents grounded."""
    out = plain_prompt(question, domain, style)
    if documents is not None:
        grounded = domain.isin("Finance", "IS") & (F.length(documents) > 0)
        out = F.when(grounded, grounded_prompt(question, documents)).otherwise(out)
    if options is not None:
        choice = (domain == "Medicine") & (F.size(options) > 0)
        out = F.when(choice, mcq_prompt(question, options)).otherwise(out)
    return out


FORMATTERS = {"simple": plain_prompt, "mcq": mcq_prompt, "grounded": grounded_prompt}


def chat_messages(prompt: Column, system: Column | None = None) -> Column:
    """``array<struct<role,content>>``: the system turn, if not blank, then the user turn."""
    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = turn("user", prompt)
    if system is None:
        return F.array(user)
    return F.when(F.length(system) > 0, F.array(turn("system", system), user)).otherwise(F.array(user))


def table_text(table: Column) -> Column:
    """Cells joined by a bar, rows by a newline."""
    return F.array_join(F.transform(table, lambda row: F.array_join(row, " | ", "None")), "\n")


def paragraphs_text(paragraphs: Column) -> Column:
    """Paragraphs by ``order`` (0 if absent, ties as given), blank line between."""
    keyed = F.transform(paragraphs, lambda p, i: F.struct(
        F.coalesce(p["order"], F.lit(0)).alias("o"), i.alias("i"), p["text"].alias("t")))
    texts = F.transform(F.array_sort(keyed), lambda p: p["t"])
    return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n\n")


def context_text(paragraphs: Column, table: Column) -> Column:
    para = F.coalesce(paragraphs_text(paragraphs), F.lit(""))
    grid = F.coalesce(table_text(table), F.lit(""))
    return F.concat_ws("\n\n", F.nullif(para, F.lit("")),
                       F.when(grid != "", F.concat(F.lit("TABLE:\n"), grid)))
