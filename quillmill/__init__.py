"""quillmill: Spark-first preparation, auditing and scoring of fine-tuning text."""
