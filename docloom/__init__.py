"""docloom: document and quality-record analytics as Spark DataFrame plans."""
