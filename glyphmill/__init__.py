"""glyphmill: formula diagnostics and repair over document corpora, as Spark plans."""
