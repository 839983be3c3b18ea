"""Writers: verified copies, the file queue, reports."""
