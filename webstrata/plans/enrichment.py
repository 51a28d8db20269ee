"""Step 2: URL list to main table, resuming where an earlier run stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame

from webstrata.operators import enrich
from webstrata.sources import sinks


def run(
    url_list: DataFrame,
    pages: DataFrame,
    out: str,
    done: DataFrame | None = None,
    rows_per_file: int | None = None,
    served: bool = False,
    order: str | None = None,
) -> None:
    """Append the usable rows of all URLs that are not in ``done``.

    With ``served`` the pages carry ``status`` and ``content_type``, and only those that
    answered with HTML count. With ``order`` a URL may have several captures, of which the
    first by that column is taken; without it ``pages`` has one row per URL.
    """
    todo = enrich.to_do(url_list, done) if done is not None else enrich.one_label(url_list)
    source = enrich.served_as_html(pages) if served else pages
    if order:
        source = enrich.one_capture(source, order)
    rows = enrich.usable(enrich.enrich(enrich.fetched(todo, source, "inner")))
    sinks.append_pages(rows, out, rows_per_file)
