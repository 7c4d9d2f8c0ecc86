"""A data sink for HTML pages: tasks write whole pages to a folder of the job's own, and the commit moves them to their places."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """Pages that a task has written: where they are now, and their names."""

    pages: list[tuple[str, str]]


class PageWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri
        self.attempts = f".pages-{uuid.uuid4().hex}"

    def store(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.uri)
        return store, path.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        """Rows (page, part, section, html) come by page and section: one file is open at a time, and none is held in memory."""
        store, base = self.store()
        own = f"{base}/{self.attempts}/{uuid.uuid4().hex}"
        out, pages, page, section = None, [], None, None

        def put(*lines: str) -> None:
            out.write("".join(f"{x}\n" for x in lines).encode())

        try:
            for r in rows:
                if r.page != page:
                    if out:
                        put(*["</table>"] * bool(section))
                        out.close()
                    store.create_dir(own)
                    page, section = r.page, ""
                    pages.append((f"{own}/{len(pages)}", page))
                    out = store.open_output_stream(pages[-1][0])
                if r.section != section:
                    put(*["</table>"] * bool(section), f"<h2>{escape(r.section)}</h2>", "<table>")
                    section = r.section
                put(r.html)
            if out:
                put(*["</table>"] * bool(section))
        finally:
            if out:
                out.close()
        return Written(pages)

    def clear(self) -> None:
        from pyarrow import fs

        store, base = self.store()
        if store.get_file_info(f"{base}/{self.attempts}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.attempts}")

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self.store()
        for m in messages:
            for now, name in m.pages if m else []:
                store.move(now, f"{base}/{name}")
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()


class Pages(DataSource):
    """Pages of rows (page string, part int, section string, html string), sorted by page within each partition; a page is in one partition."""

    @classmethod
    def name(cls) -> str:
        return "html_pages"

    def schema(self) -> str:
        return "page string, part int, section string, html string"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])
