"""Reading and keeping documents: files and folders, transcripts, HTML, SQLite files, the chunk store."""
