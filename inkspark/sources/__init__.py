"""Reading and writing: file scans, snapshots, catalogues, archives, case files, the answer store, reports."""
