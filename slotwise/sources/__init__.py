from slotwise.sources.tables import (
    append_report,
    materialize,
    nan_to_null,
    read_jdbc,
    read_report,
    read_table,
    read_tsv,
    run_record,
    write_report,
    write_tsv,
)

__all__ = [
    "append_report", "materialize", "nan_to_null", "read_jdbc", "read_report", "read_table", "read_tsv", "run_record",
    "write_report", "write_tsv",
]
