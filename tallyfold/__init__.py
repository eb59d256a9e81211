"""tallyfold: conversation-record analytics as DataFrame-to-DataFrame functions on PySpark."""
