"""callweave.streaming"""
