"""Inputs of model calls and what to do when one fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a query at most.
QUERY_CHARS = 2000

_NUMBER = "^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$"


def locator(slide: Column, notes: Column, page: Column, section: Column) -> Column:
    """Where a span is, in words: its slide, with its notes or not, else its page, else its section."""
    on_slide = F.concat(F.lit("slide "), slide.cast("string"), F.when(notes, " notes").otherwise(""))
    named = F.when(section != "", section)
    return F.coalesce(on_slide, F.concat(F.lit("page "), page.cast("string")), named, F.lit("section"))


def material(spans: Column) -> Column:
    """Blocks ``[S1] locator, line break, excerpt`` of an array of (order, locator, excerpt), a blank line between."""
    block = F.transform(F.array_sort(spans), lambda s, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), s["locator"], F.lit("\n"), s["excerpt"]))
    return F.array_join(block, "\n\n")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def query_input(question: Column, task: str) -> Column:
    """The stripped question behind the task; null where it is empty or too long."""
    bare = stripped(question)
    return F.when((bare != "") & (F.length(bare) <= QUERY_CHARS), F.concat(F.lit(f"Instruct: {task}\nQuery:"), bare))


def document_input(text: Column) -> Column:
    """The text as it is; null where nothing of it is visible."""
    return F.when(text.rlike("(?U)\\S"), text)


def mapping_query(requirement: Column, assessment: Column, course: Column) -> Column:
    lines = F.concat(F.lit("Requirement: "), requirement, F.lit("\nAssessment: "), assessment, F.lit("\nCourse: "), course)
    return F.left(lines, F.lit(QUERY_CHARS))


def placeholder_vector(key: Column) -> Column:
    """Eight components from 1 to 2 that the hash of ``key`` fixes; never all zero."""
    digest = F.sha2(key, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 1 + F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255)


def retry_after(milliseconds: Column, seconds: Column) -> Column:
    """Seconds that a server asks to wait: the header in milliseconds, else that in seconds; dates and negatives count for nothing."""

    def number(header: Column, scale: float) -> Column:
        value = F.when(header.rlike(_NUMBER), F.trim(header)).cast("double") * scale
        return F.when(value >= 0, value)

    return F.coalesce(number(milliseconds, 0.001), number(seconds, 1.0))


def retry_delay(retry: Column, asked: Column, draw: Column, base: float, most: float) -> Column:
    """Seconds before the retry (1 is the first); what the server asks wins, and null means that it asks for too long."""
    ceiling = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), retry - 1))
    return F.when(asked.isNull(), draw * ceiling).when(asked <= most, asked)


def status_category(status: Column) -> Column:
    """The category of an error by its HTTP status."""
    return (
        F.when(status == 429, "rate_limited")
        .when(status == 408, "timeout")
        .when(status.isin(501, 505), "invalid_request")
        .when(status >= 500, "server_error")
        .when(status.isin(401, 403), "authentication")
        .otherwise("invalid_request")
    )
