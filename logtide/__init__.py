"""Log monitoring and anomaly detection as Spark DataFrame operators."""
