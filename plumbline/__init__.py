"""Answer-reliability analytics for multiple-choice question answering, on Spark."""
