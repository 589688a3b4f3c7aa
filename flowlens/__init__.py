"""Process-mining, ERP-forensics and training-data operators as Spark DataFrame functions."""
