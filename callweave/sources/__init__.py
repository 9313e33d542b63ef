"""callweave.sources"""
