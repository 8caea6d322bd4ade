"""Files written from the given tables, so that readers have something to read."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from tablelens.session import spread
from tablelens.sources.arrow_ipc import _open

ROWS_PER_SHEET = 500_000


def _save(folder: str, name: str, data: bytes) -> None:
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{name}") as out:
        out.write(data)


def write_ipc(df: DataFrame, folder: str) -> None:
    """One Arrow IPC file per partition."""

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held = list(batches)
        if held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, held[0].schema) as writer:
                for batch in held:
                    writer.write_batch(batch)
            part = TaskContext.get().partitionId()
            _save(folder, f"part-{part:05d}.arrow", sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_pydict({"rows": [sum(b.num_rows for b in held)]})

    df.mapInArrow(save, "rows bigint").collect()  # one row per partition


def sheet_xml(rows: list[list], first_row: int = 1, merged: list[str] = ()) -> str:
    """A worksheet from Python values; None leaves a cell out."""

    def letters(i: int) -> str:
        return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    lines = []
    for r, row in enumerate(rows, first_row):
        cells = []
        for c, v in enumerate(row):
            ref = f"{letters(c)}{r}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
            else:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    regions = "".join(f'<mergeCell ref="{m}"/>' for m in merged)
    tail = f'<mergeCells count="{len(merged)}">{regions}</mergeCells>' if merged else ""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    return f'<?xml version="1.0"?><worksheet {space}><sheetData>{"".join(lines)}</sheetData>{tail}</worksheet>'


def workbook_bytes(sheets: dict[str, str]) -> bytes:
    """A minimal .xlsx file from sheet name -> worksheet XML."""
    import io

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    names = "".join(
        f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)
    )
    links = "".join(
        f'<Relationship Id="rId{i}" Type="worksheet" Target="worksheets/sheet{i}.xml"/>'
        for i in range(1, len(sheets) + 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f"<workbook {main} {link}><sheets>{names}</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        for i, xml in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", xml)
    return out.getvalue()


def write_xlsx(df: DataFrame, folder: str) -> None:
    """One workbook per partition and half million rows, all with the same header; a small table is dealt to all cores."""
    header = df.columns

    def save(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, book, rows, total = TaskContext.get().partitionId(), 0, [header], 0

        def flush():
            _save(folder, f"part-{part:05d}-{book:03d}.xlsx", workbook_bytes({"Sheet1": sheet_xml(rows)}))

        for batch in batches:
            total += batch.num_rows
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                rows.append(list(row))
                if len(rows) > ROWS_PER_SHEET:
                    flush()
                    book, rows = book + 1, [header]
        if len(rows) > 1:
            flush()
        yield pa.RecordBatch.from_pydict({"rows": [total]})

    spread(df).mapInArrow(save, "rows bigint").collect()  # one row per partition
