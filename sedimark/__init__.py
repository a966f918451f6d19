"""sedimark: software-composition analytics and corpus preparation on Spark DataFrames."""
