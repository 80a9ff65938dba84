"""docpair: comparing pairs of text documents at batch scale on Spark."""
