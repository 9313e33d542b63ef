"""callweave.functions"""
