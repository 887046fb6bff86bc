"""Sheet specs: parsing, guards, compilation to DataFrames, preview, workbook output."""
