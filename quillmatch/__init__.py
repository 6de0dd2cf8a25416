"""quillmatch: catalogue matching, lookup and record keeping as Spark DataFrame plans."""
