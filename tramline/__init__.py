"""Public-transit analytics and corpus preparation on Spark."""
