from strata.sources.readers import (
    TABLES, csv_rejects, normalize_missing, read_csv, read_first_existing, read_table, records_table, shape,
)
from strata.sources.sinks import load_params, save_params, write_prediction, write_table

__all__ = [
    "TABLES", "csv_rejects", "normalize_missing", "read_csv", "read_first_existing", "read_table",
    "records_table", "shape", "load_params", "save_params", "write_prediction", "write_table",
]
