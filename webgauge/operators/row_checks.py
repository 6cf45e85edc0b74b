"""User checks of single pages, in Python, run by a table function with isolation: a check that fails on a page costs that page's row of that
check, and neither the others nor the job."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: (code, severity, detail) of each issue that a check finds on a page; None stands for no issue.
RowCheck = Callable[[Row], Iterable[tuple[str, str, dict[str, str] | None]] | None]
ISSUE = "check: string, code: string, severity: string, detail: map<string,string>"
SEVERITIES = ("Info", "Warning", "Error")


def _issues(name: str, check: RowCheck, page: Row) -> list[tuple]:
    """What a check says of a page, whole or not at all; its failure is an issue of its own."""
    try:
        found = []
        for code, severity, detail in check(page) or ():
            if not isinstance(code, str) or severity not in SEVERITIES:
                raise ValueError(f"no issue: {code!r}, {severity!r}")
            found.append((name, code, severity, None if detail is None else {str(k): str(v) for k, v in detail.items()}))
        return found
    except Exception as e:
        return [(name, "CHECK_FAILED", "Error", {"message": f"{name}: {e}", "type": type(e).__name__})]


def run_row_checks(pages: DataFrame, checks: dict[str, RowCheck], keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, check, code, severity, detail) of the checks in their order, by a lateral join with a table function.

    A check gets a row of `columns`, the only ones that go to Python beside the keys.  A page without issues has no row.  A check that raises, or
    gives something else than issues, gives a CHECK_FAILED row of severity Error with the message in place of what it said of that page; other checks
    of the page and other pages go on.  Repeated rows give their issues each; an empty table gives none.
    """

    class Checks:
        def eval(self, page):
            for name, check in checks.items():
                yield from _issues(name, check, page)

    run = F.udtf(Checks, returnType=ISSUE)
    page = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("page")
    rows = pages.select(*(F.col(f"`{k}`") for k in keys), page)
    return rows.lateralJoin(run(F.col("page").outer())).drop("page")
