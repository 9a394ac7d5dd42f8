"""Reading and writing of corpora, cells, records, reports."""
