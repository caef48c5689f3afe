"""flowloom: network-flow analytics and intrusion detection on Spark DataFrames."""
